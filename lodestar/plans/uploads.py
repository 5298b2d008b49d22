"""Upload sessions over orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.keys import backoff_ms
from lodestar.operators import accounting as op_accounts
from lodestar.operators import folds
from lodestar.operators import uploads as op
from lodestar.plans.registry import query
from lodestar.sources.drive import ENTRIES_SQL, entries, objects, table

#: A total order of a part's writes.
TOTAL = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
TOTAL_SQL = ", ".join(f"{c} DESC" for c in TOTAL)
PARTS_SQL = f"""parts AS (SELECT l_orderkey AS session_id, l_linenumber AS part_number, (l_quantity * 1048576)::BIGINT AS size_bytes FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {TOTAL_SQL}) = 1)"""
PLAN_SQL = """plan AS (SELECT o_orderkey AS session_id, size_bytes, part_size, ceil(size_bytes / part_size::DOUBLE)::BIGINT AS part_count FROM (
    SELECT o_orderkey, size_bytes, (10485760 * pow(2, len(list_filter(range(0, 40), lambda j: size_bytes::DOUBLE > 10485760.0 * 10000 * pow(2, j)))))::BIGINT AS part_size
    FROM (SELECT o_orderkey, (o_totalprice * (1 + o_orderkey % 7) * 262144)::BIGINT AS size_bytes FROM orders)))"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumns({"session_id": F.col("l_orderkey"), "part_number": F.col("l_linenumber")})
    return op.latest_parts(lines, [F.desc(c) for c in TOTAL]).select("session_id", "part_number", F.round(F.col("l_quantity") * 1048576).cast("long").alias("size_bytes"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.round(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 7) * 262144).cast("long")
    status = F.when(F.col("o_orderstatus") == "F", "verifying").when(F.col("o_orderstatus") == "O", "uploading").otherwise("created")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("owner_id"), size.alias("size_bytes"), status.alias("status"), F.col("o_orderdate").alias("expires_at"))


@query("multipart_plan", f"WITH {PLAN_SQL} SELECT session_id, size_bytes, part_size, part_count FROM plan")
def multipart_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.planned(sessions(spark, sf_dir)).select("session_id", "size_bytes", "part_size", "part_count")


@query("latest_part", f"WITH {PARTS_SQL} SELECT * FROM parts")
def latest_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir)


EXPECTED = "1 + session_id % 7"


@query(
    "part_completeness",
    f"""WITH {PARTS_SQL}, s AS (SELECT o_orderkey AS session_id, 1 + o_orderkey % 7 AS part_count FROM orders),
        c AS (SELECT session_id, count(*) AS n, sum(size_bytes)::BIGINT AS b FROM parts GROUP BY session_id)
        SELECT session_id, coalesce(n, 0) AS confirmed, coalesce(b, 0) AS confirmed_bytes, coalesce(n, 0) = part_count AS complete, least(90, 100 * coalesce(n, 0) // part_count)::INT AS progress
        FROM s LEFT JOIN c USING (session_id)""",
)
def part_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = sessions(spark, sf_dir).select("session_id", F.expr(EXPECTED).alias("part_count"))
    return op.completeness(expected, parts(spark, sf_dir))


@query(
    "nested_parts",
    f"""WITH {PARTS_SQL} SELECT o_orderkey AS session_id, string_agg(part_number || '=' || size_bytes, ',' ORDER BY part_number) AS parts FROM orders LEFT JOIN parts ON session_id = o_orderkey GROUP BY o_orderkey""",
)
def nested_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = op.nested_parts(sessions(spark, sf_dir).select("session_id"), parts(spark, sf_dir))
    return nested.select("session_id", F.array_join(F.transform("parts", lambda p: F.concat(p.part_number, F.lit("="), p["size_bytes"])), ",").alias("parts"))


@query(
    "verify_objects",
    """WITH known AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id)),
       s AS (SELECT doc_id, sha256(text) AS declared, strlen(text)::BIGINT AS size, lang = 'es' AS missing, lang = 'fr' AS wrong FROM documents)
       SELECT doc_id AS session_id, CASE WHEN missing OR wrong THEN 'failed' WHEN h IS NOT NULL THEN 'reused' ELSE 'created' END AS outcome,
              CASE WHEN missing OR wrong THEN 'upload.verification_failed' END AS error_code, CASE WHEN missing OR wrong THEN size ELSE 0 END AS released_bytes
       FROM s LEFT JOIN known ON h = declared""",
)
def verify_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: Spanish ones were never staged, French ones have other bytes, and labelled content is known."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), "lang")
    staged = docs.filter("lang <> 'es'").withColumn("sha256", F.when(F.col("lang") == "fr", "0").otherwise(F.col("sha256")))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"))
    known = docs.join(labelled, "session_id", "left_semi").select(F.col("sha256").alias("object_id")).distinct()
    return op.verified(docs.drop("lang"), known, staged)


@query(
    "expire_sessions",
    """SELECT o_orderkey AS session_id, o_custkey AS owner_id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100""",
)
def expire_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.expired(sessions(spark, sf_dir), F.expr("TIMESTAMP_NTZ '1996-01-01'")).select("session_id", "owner_id")


@query(
    "upload_decision",
    f"""WITH e AS ({ENTRIES_SQL}),
        r AS (SELECT doc_id, doc_id % 4 AS owner_id, source AS folder_id, CASE WHEN doc_id % 3 = 0 THEN (SELECT any_value(name) FROM e WHERE file_id = doc_id) ELSE 'new-' || doc_id END AS name,
                     CASE WHEN doc_id % 5 = 0 THEN 'x' WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256('new' || doc_id) END AS h, strlen(text) AS size, 'k' || doc_id AS key FROM documents),
        s AS (SELECT DISTINCT o_custkey % 4 AS owner_id, 'k' || o_custkey AS key, 'src' || o_custkey % 20 AS folder_id, 'new-' || (o_custkey + 4) AS name, o_orderdate AS expires_at FROM orders WHERE o_orderstatus = 'P'),
        live AS (SELECT * FROM e WHERE NOT deleted)
        SELECT doc_id AS request_id, CASE WHEN h = 'x' OR size = 0 THEN 'invalid'
               WHEN EXISTS (SELECT 1 FROM s WHERE s.owner_id = r.owner_id AND s.key = r.key) THEN 'replay'
               WHEN EXISTS (SELECT 1 FROM live WHERE live.owner_id = r.owner_id AND live.folder_id = r.folder_id AND live.name = r.name)
                 OR EXISTS (SELECT 1 FROM s WHERE s.owner_id = r.owner_id AND s.folder_id = r.folder_id AND s.name = r.name AND s.expires_at > TIMESTAMP '1995-01-01') THEN 'name_conflict'
               WHEN size > 2000 THEN 'quota_exceeded'
               WHEN EXISTS (SELECT 1 FROM live WHERE live.owner_id = r.owner_id AND live.object_id = r.h AND live.size_bytes = r.size) THEN 'instant' ELSE 'multipart' END AS decision FROM r""",
)
def upload_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = entries(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").join(files.select(F.col("file_id").alias("doc_id"), F.col("name").alias("_own")), "doc_id")
    doc = F.col("doc_id")
    requests = docs.select(
        doc.alias("request_id"),
        F.pmod(doc, F.lit(4)).alias("owner_id"),
        F.col("source").alias("folder_id"),
        F.when(doc % 3 == 0, F.col("_own")).otherwise(F.concat(F.lit("new-"), doc)).alias("name"),
        F.when(doc % 5 == 0, "x").when(doc % 2 == 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat(F.lit("new"), doc), 256)).alias("sha256"),
        F.octet_length("text").alias("size_bytes"),
        F.concat(F.lit("k"), doc).alias("idempotency_key"),
    )
    customer = F.col("o_custkey")
    earlier = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.pmod(customer, F.lit(4)).alias("owner_id"),
        F.concat(F.lit("k"), customer).alias("idempotency_key"),
        F.concat(F.lit("src"), customer % 20).alias("folder_id"),
        F.concat(F.lit("new-"), customer + 4).alias("name"),
        F.lit("uploading").alias("status"),
        F.col("o_orderdate").alias("expires_at"),
    )
    accounts = op_accounts.usage(files, 0).select("owner_id", "used_bytes", F.lit(0).alias("reserved_bytes"), (F.col("used_bytes") + 2000).alias("quota_bytes"))
    return op.decisions(requests, earlier, files, F.expr("TIMESTAMP_NTZ '1995-01-01'"), accounts)


@query("retry_backoff", "SELECT l_orderkey, l_linenumber, min(least(100 * pow(2, l_linenumber - 1), 2000))::BIGINT AS delay_ms FROM lineitem GROUP BY ALL")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(backoff_ms(F.col("l_linenumber"), 100, 2000)).alias("delay_ms"))


@query("new_objects", "SELECT sha256(text) AS object_id, strlen(any_value(text))::BIGINT AS size_bytes FROM documents GROUP BY 1")
def new_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).select("object_id", "size_bytes")


ADMISSION_SQL = f"""WITH RECURSIVE e AS ({ENTRIES_SQL}),
    r0 AS (SELECT doc_id AS request_id, doc_id % 4 AS owner_id, source AS folder_id, CASE WHEN doc_id % 3 = 0 THEN e.name ELSE 'new-' || doc_id % 40 END AS name,
             CASE WHEN doc_id % 5 = 0 THEN 'x' WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256('new' || doc_id) END AS h, strlen(text)::BIGINT AS size,
             'k' || CASE WHEN doc_id % 9 = 0 THEN doc_id - 4 ELSE doc_id END AS key FROM documents JOIN e ON file_id = doc_id),
    s AS (SELECT DISTINCT o_custkey % 4 AS owner_id, 'k' || o_custkey AS key, 'src' || o_custkey % 20 AS folder_id, 'new-' || (o_custkey + 4) AS name, o_orderdate AS expires_at FROM orders WHERE o_orderstatus = 'P'),
    live AS (SELECT * FROM e WHERE NOT deleted),
    a AS (SELECT owner_id, sum(size_bytes)::BIGINT AS used FROM live GROUP BY owner_id),
    r AS (SELECT r0.*, coalesce(used, 0) AS base, row_number() OVER (PARTITION BY r0.owner_id ORDER BY request_id) AS n, h <> 'x' AND size > 0 AS valid,
             EXISTS (SELECT 1 FROM s WHERE s.owner_id = r0.owner_id AND s.key = r0.key) AS replay,
             EXISTS (SELECT 1 FROM live WHERE live.owner_id = r0.owner_id AND live.folder_id = r0.folder_id AND live.name = r0.name)
               OR EXISTS (SELECT 1 FROM s WHERE s.owner_id = r0.owner_id AND s.folder_id = r0.folder_id AND s.name = r0.name AND s.expires_at > TIMESTAMP '1995-01-01') AS taken,
             EXISTS (SELECT 1 FROM live WHERE live.owner_id = r0.owner_id AND live.object_id = r0.h AND live.size_bytes = r0.size) AS held FROM r0 LEFT JOIN a USING (owner_id)),
    f AS (SELECT owner_id, 0::BIGINT AS n, 0::BIGINT AS request_id, '' AS decision, []::VARCHAR[] AS keys, []::VARCHAR[] AS names, min(base) AS used, 0::BIGINT AS reserved, min(base) + 200000 AS quota FROM r GROUP BY owner_id
          UNION ALL
          SELECT owner_id, n, request_id, decision, CASE WHEN ok THEN list_append(keys, key) ELSE keys END, CASE WHEN ok THEN list_append(names, folder_id || '/' || name) ELSE names END,
                 used + CASE WHEN decision = 'instant' THEN size ELSE 0 END, reserved + CASE WHEN decision = 'multipart' THEN size ELSE 0 END, quota
          FROM (SELECT *, decision IN ('instant', 'multipart') AS ok FROM (SELECT r.owner_id, r.n, r.request_id, r.key, r.folder_id, r.name, r.size, f.keys, f.names, f.used, f.reserved, f.quota,
                 CASE WHEN NOT r.valid THEN 'invalid' WHEN r.replay OR list_contains(f.keys, r.key) THEN 'replay' WHEN r.taken OR list_contains(f.names, r.folder_id || '/' || r.name) THEN 'name_conflict'
                      WHEN r.size > f.quota - f.used - f.reserved THEN 'quota_exceeded' WHEN r.held THEN 'instant' ELSE 'multipart' END AS decision
                 FROM f JOIN r ON r.owner_id = f.owner_id AND r.n = f.n + 1)))"""


def create_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A batch of requests whose names and keys repeat, earlier sessions, entries, and accounts with 200,000 free bytes."""
    files = entries(spark, sf_dir)
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(files.select(F.col("file_id").alias("doc_id"), F.col("name").alias("_own")), "doc_id")
    requests = docs.select(
        doc.alias("request_id"),
        F.pmod(doc, F.lit(4)).alias("owner_id"),
        F.col("source").alias("folder_id"),
        F.when(doc % 3 == 0, F.col("_own")).otherwise(F.concat(F.lit("new-"), doc % 40)).alias("name"),
        F.when(doc % 5 == 0, "x").when(doc % 2 == 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat(F.lit("new"), doc), 256)).alias("sha256"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.concat(F.lit("k"), F.when(doc % 9 == 0, doc - 4).otherwise(doc)).alias("idempotency_key"),
    )
    customer = F.col("o_custkey")
    earlier = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.pmod(customer, F.lit(4)).alias("owner_id"),
        F.concat(F.lit("k"), customer).alias("idempotency_key"),
        F.concat(F.lit("src"), customer % 20).alias("folder_id"),
        F.concat(F.lit("new-"), customer + 4).alias("name"),
        F.lit("uploading").alias("status"),
        F.col("o_orderdate").alias("expires_at"),
    )
    accounts = op_accounts.usage(files, 0).select("owner_id", "used_bytes", F.lit(0).cast("long").alias("reserved_bytes"), (F.col("used_bytes") + 200000).alias("quota_bytes"))
    return requests, earlier, files, accounts


def admitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests, earlier, files, accounts = create_requests(spark, sf_dir)
    return requests, op.admissions(requests, earlier, files, accounts, F.expr("TIMESTAMP_NTZ '1995-01-01'"))


@query("upload_admission", f"{ADMISSION_SQL} SELECT request_id, owner_id, decision, used AS used_bytes, reserved AS reserved_bytes FROM f WHERE n > 0")
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir)[1].select("request_id", "owner_id", "decision", "used_bytes", "reserved_bytes")


@query(
    "upload_sessions",
    f"""{ADMISSION_SQL} SELECT sha256('session:' || f.owner_id || ':' || key) AS session_id, f.owner_id, folder_id, name, size AS size_bytes, CASE decision WHEN 'instant' THEN 'completed' ELSE 'created' END AS status,
        CASE decision WHEN 'instant' THEN 0 ELSE size END AS reserved_bytes, CASE decision WHEN 'instant' THEN 0 ELSE 1 END AS part_count FROM f JOIN r USING (request_id) WHERE decision IN ('instant', 'multipart')""",
)
def upload_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.new_sessions(*admitted(spark, sf_dir))
    return rows.select("session_id", "owner_id", "folder_id", "name", "size_bytes", "status", "reserved_bytes", F.col("part_count").cast("int").alias("part_count"))


@query("upload_entries", f"{ADMISSION_SQL} SELECT f.owner_id, folder_id, h AS object_id, name, size AS size_bytes FROM f JOIN r USING (request_id) WHERE decision = 'instant'")
def upload_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.new_entries(*admitted(spark, sf_dir)).select("owner_id", "folder_id", "object_id", "name", "size_bytes")


@query("upload_usage", f"{ADMISSION_SQL} SELECT owner_id, arg_max(used, n) AS used_bytes, arg_max(reserved, n) AS reserved_bytes FROM f GROUP BY owner_id")
def upload_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.usage_after(admitted(spark, sf_dir)[1])


def moves_sql(log: str, moves: tuple[tuple[str, str, str], ...], first: str, refusal: str) -> str:
    """The states of a log (k, n from 1, command, ready, and what it is shown with) by recursion over n."""
    rows = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in moves)
    return f"""{log}, moves AS (SELECT * FROM (VALUES {rows}) AS t(a, b, c)),
    f AS (SELECT DISTINCT k, 0::BIGINT AS n, '{first}' AS from_state, '{first}' AS to_state, true AS accepted, NULL::VARCHAR AS reason FROM log
          UNION ALL SELECT l.k, l.n, f.to_state, CASE WHEN c IS NULL OR (c <> f.to_state AND ready = false) THEN f.to_state ELSE c END,
            c IS NOT NULL AND NOT (c <> f.to_state AND coalesce(ready, true) = false), CASE WHEN c IS NULL THEN 'conflict' WHEN c <> f.to_state AND coalesce(ready, true) = false THEN '{refusal}' END
          FROM f JOIN log l ON l.k = f.k AND l.n = f.n + 1 LEFT JOIN moves ON a = f.to_state AND b = command)"""


LOG_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
SESSION_LOG = f"""WITH RECURSIVE steps AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LOG_ORDER)}) AS n, l_linenumber,
      CASE WHEN l_partkey % 16 = 0 THEN 'abort' WHEN l_partkey % 16 = 1 THEN 'expire' WHEN l_partkey % 4 = 2 THEN 'complete' WHEN l_partkey % 8 = 5 THEN 'accept' WHEN l_partkey % 16 = 9 THEN 'reject' ELSE 'confirm' END AS command FROM lineitem),
    log AS (SELECT k, n, command, CASE WHEN command = 'complete' THEN (SELECT count(DISTINCT p.l_linenumber) FROM steps p WHERE p.k = s.k AND p.n < s.n AND p.command = 'confirm') = 1 + k % 3 END AS ready FROM steps s)"""


@query("session_transitions", f"{moves_sql(SESSION_LOG, folds.SESSION_MOVES, 'created', 'parts_missing')} SELECT k AS session_id, n, from_state, to_state, accepted, reason FROM f WHERE n > 0")
def session_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as commands to its session; a completion is ready once as many parts are confirmed as the session has."""
    part = F.col("l_partkey")
    command = F.when(part % 16 == 0, "abort").when(part % 16 == 1, "expire").when(part % 4 == 2, "complete").when(part % 8 == 5, "accept").when(part % 16 == 9, "reject").otherwise("confirm")
    order = Window.partitionBy("l_orderkey").orderBy(*LOG_ORDER)
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.row_number().over(order).cast("long").alias("n"), "l_linenumber", command.alias("command"))
    before = Window.partitionBy("session_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    confirmed = F.size(F.collect_set(F.when(F.col("command") == "confirm", F.col("l_linenumber"))).over(before))
    log = steps.withColumn("ready", F.when(F.col("command") == "complete", confirmed == 1 + F.col("session_id") % 3)).drop("l_linenumber")
    done = folds.transitions(log, folds.SESSION_MOVES, "created", "session_id", ["n"], "parts_missing")
    return done.select("session_id", "n", "from_state", "to_state", "accepted", "reason")


GC_LOG = f"""WITH RECURSIVE e AS ({ENTRIES_SQL}), o AS (SELECT object_id AS k, bool_and(deleted) AS free, min(file_id) % 5 <> 0 AS still FROM e WHERE object_id IS NOT NULL GROUP BY object_id),
    log AS (SELECT k, 1::BIGINT AS n, 'collect' AS command, free AS ready FROM o UNION ALL SELECT k, 2, 'finish', free AND still FROM o)"""


@query("gc_states", f"{moves_sql(GC_LOG, folds.OBJECT_MOVES, 'ready', 'referenced')} SELECT k AS object_id, n, from_state, to_state, accepted, reason FROM f WHERE n > 0")
def gc_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that nothing refers to are collected in two steps; those that a fifth of the files took up in between aren't finished."""
    held = entries(spark, sf_dir).filter("object_id IS NOT NULL").groupBy("object_id").agg(F.bool_and("deleted").alias("free"), (F.min("file_id") % 5 != 0).alias("still"))
    one = lambda n, c, r: F.struct(F.lit(n).cast("long").alias("n"), F.lit(c).alias("command"), r.alias("ready"))
    log = held.select("object_id", F.explode(F.array(one(1, "collect", F.col("free")), one(2, "finish", F.col("free") & F.col("still")))).alias("x")).select("object_id", "x.*")
    return folds.transitions(log, folds.OBJECT_MOVES, "ready", "object_id", ["n"], "referenced").select("object_id", "n", "from_state", "to_state", "accepted", "reason")


@query(
    "token_rotation",
    """WITH RECURSIVE u AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
       l AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN n WHEN event_id % 29 = 0 THEN n - 2 ELSE n - 1 END AS token_no FROM u),
       f AS (SELECT DISTINCT k, 0::BIGINT AS n, 0::BIGINT AS event_id, 0::BIGINT AS cur, true AS alive, '' AS verdict, NULL::BIGINT AS issued FROM l
             UNION ALL SELECT l.k, l.n, l.event_id, CASE WHEN token_no = cur AND alive THEN cur + 1 ELSE cur END, alive AND NOT (token_no BETWEEN 0 AND cur AND (token_no < cur OR NOT alive)),
               CASE WHEN token_no > cur OR token_no < 0 THEN 'unknown' WHEN token_no < cur OR NOT alive THEN 'reused' ELSE 'rotated' END, CASE WHEN token_no = cur AND alive THEN cur + 1 END
             FROM f JOIN l ON l.k = f.k AND l.n = f.n + 1)
       SELECT event_id AS use_id, k AS family_id, verdict, issued AS issued_no FROM f WHERE n > 0""",
)
def token_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as uses of its tokens in turn; some present a token that comes later, some one from before."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("n", n)
    token = F.when(F.col("event_id") % 13 == 0, F.col("n")).when(F.col("event_id") % 29 == 0, F.col("n") - 2).otherwise(F.col("n") - 1)
    uses = rows.select(F.col("user_id").alias("family_id"), F.col("event_id").alias("use_id"), F.col("ts").alias("used_at"), token.alias("token_no"))
    return folds.token_rotations(uses).select("use_id", "family_id", "verdict", "issued_no")
