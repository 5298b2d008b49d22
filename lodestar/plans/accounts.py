"""Quotas, shares, leases and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.keys import access_token, accessed_share, base64url, hmac_sha256
from lodestar.operators import accounting as op
from lodestar.plans.registry import query
from lodestar.sources.drive import ENTRIES_SQL, entries, table

QUOTA = 500_000
NOW = "TIMESTAMP_NTZ '2024-01-20'"


@query("quota_usage", f"SELECT owner_id, sum(size_bytes)::BIGINT AS used_bytes, count(*) AS files, greatest({QUOTA} - sum(size_bytes), 0)::BIGINT AS free_bytes FROM ({ENTRIES_SQL}) WHERE NOT deleted GROUP BY owner_id")
def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.usage(entries(spark, sf_dir), QUOTA)


@query(
    "quota_admission",
    """WITH l AS (SELECT o_custkey AS owner_id, list(struct_pack(i := o_orderkey, s := o_totalprice::BIGINT) ORDER BY o_orderkey) AS xs FROM orders GROUP BY o_custkey),
       f AS (SELECT owner_id, list_reduce(list_prepend(struct_pack(u := 0::BIGINT, done := []::BOOLEAN[]), list_transform(xs, lambda x: struct_pack(u := x.s, done := []::BOOLEAN[]))),
                lambda a, x: struct_pack(u := CASE WHEN a.u + x.u <= 500000 THEN a.u + x.u ELSE a.u END, done := list_append(a.done, a.u + x.u <= 500000))) AS r, xs FROM l)
       SELECT owner_id, unnest(list_transform(xs, lambda x: x.i)) AS request_id, unnest(r.done) AS admitted FROM f""",
)
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("request_id"), F.round("o_totalprice").cast("long").alias("size_bytes"))
    return op.admitted(requests, QUOTA)


@query(
    "quota_moves",
    """WITH l AS (SELECT o_custkey AS owner_id, list(struct_pack(i := o_orderkey, k := o_orderkey % 5, s := floor(o_totalprice)::BIGINT) ORDER BY o_orderkey) AS xs FROM orders GROUP BY o_custkey),
       f AS (SELECT owner_id, xs, list_reduce(list_prepend(struct_pack(u := 0::BIGINT, r := 0::BIGINT, k := 0::BIGINT, d := []::STRUCT(ok BOOLEAN, u BIGINT, r BIGINT)[]), list_transform(xs, lambda x: struct_pack(u := x.s, r := 0::BIGINT, k := x.k::BIGINT, d := []::STRUCT(ok BOOLEAN, u BIGINT, r BIGINT)[]))),
         lambda a, x: struct_pack(
           u := CASE WHEN x.k = 1 AND a.u + a.r + x.u <= 500000 THEN a.u + x.u WHEN x.k = 3 THEN a.u + x.u WHEN x.k = 4 THEN greatest(a.u - x.u, 0) ELSE a.u END,
           r := CASE WHEN x.k = 0 AND a.u + a.r + x.u <= 500000 THEN a.r + x.u WHEN x.k IN (2, 3) THEN greatest(a.r - x.u, 0) ELSE a.r END,
           k := x.k,
           d := list_append(a.d, struct_pack(ok := x.k > 1 OR a.u + a.r + x.u <= 500000,
             u := CASE WHEN x.k = 1 AND a.u + a.r + x.u <= 500000 THEN a.u + x.u WHEN x.k = 3 THEN a.u + x.u WHEN x.k = 4 THEN greatest(a.u - x.u, 0) ELSE a.u END,
             r := CASE WHEN x.k = 0 AND a.u + a.r + x.u <= 500000 THEN a.r + x.u WHEN x.k IN (2, 3) THEN greatest(a.r - x.u, 0) ELSE a.r END)))) AS z FROM l),
       o AS (SELECT owner_id, unnest(list_transform(xs, lambda x: x.i)) AS move_id, unnest(z.d) AS m FROM f)
       SELECT owner_id, move_id, m.ok AS accepted, m.u AS used_bytes, m.r AS reserved_bytes FROM o""",
)
def quota_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as moves of the five kinds, by number."""
    kinds = F.array(*map(F.lit, ("reserve", "add", "release", "commit", "remove")))
    moves = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("move_id"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("kind"), F.floor("o_totalprice").cast("long").alias("size_bytes")
    )
    return op.quota_moves(moves, QUOTA)


@query(
    "share_validity",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'revoked' WHEN event_id % 3 <> 0 AND ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'valid' END AS state FROM events""",
)
def share_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shares: every seventh was revoked, two of three expire after ten days."""
    shares = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("revoked_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at")
    )
    return op.share_state(shares, F.expr(NOW)).select("event_id", "state")


@query(
    "share_resolve",
    f"""WITH e AS ({ENTRIES_SQL}), s AS (SELECT event_id AS share_id, user_id AS file_id, CASE WHEN event_id % 7 = 0 THEN 'revoked' WHEN event_id % 3 <> 0 AND ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'valid' END AS state FROM events),
        j AS (SELECT s.share_id, s.file_id, CASE WHEN s.state = 'valid' AND l.file_id IS NULL THEN 'not_found' ELSE s.state END AS state, l.name, l.size_bytes FROM s LEFT JOIN (SELECT * FROM e WHERE NOT deleted) l ON l.file_id = s.file_id)
        SELECT share_id, file_id, state, CASE WHEN state = 'valid' THEN name END AS name, CASE WHEN state = 'valid' THEN size_bytes END AS size_bytes FROM j""",
)
def share_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shares of the file with the user's number."""
    shares = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("share_id"),
        F.col("user_id").alias("file_id"),
        F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("revoked_at"),
        F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
    )
    return op.resolved_shares(shares, entries(spark, sf_dir), F.expr(NOW))


@query(
    "root_provisioning",
    """SELECT sha256('root:' || c_custkey) AS folder_id, c_custkey AS owner_id, NULL::VARCHAR AS parent_id, '/' AS name FROM customer
       WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def root_provisioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, active if they owe nothing; those with a pending order have a root."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("active"))
    roots = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("owner_id"))
    return op.provisioned(users, roots)


@query(
    "import_dedupe",
    f"""WITH e AS ({ENTRIES_SQL}),
        r AS (SELECT doc_id AS request_id, (doc_id + 1) % 4 AS user_id, doc_id % 300 AS share_id, doc_id % 2 AS k, sha256(text) AS object_id FROM documents),
        o AS (SELECT user_id, share_id, k, min(request_id) AS request_id, count(*) AS calls, arg_min(object_id, request_id) AS object_id FROM r GROUP BY ALL)
        SELECT user_id, share_id, request_id, calls, CASE WHEN EXISTS (SELECT 1 FROM e WHERE NOT deleted AND e.owner_id = o.user_id AND e.object_id = o.object_id) THEN 'exists' ELSE 'imported' END AS outcome FROM o""",
)
def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    requests = table(spark, sf_dir, "documents").select(doc.alias("request_id"), F.pmod(doc + 1, F.lit(4)).alias("user_id"), F.pmod(doc, F.lit(300)).alias("share_id"), F.pmod(doc, F.lit(2)).alias("idempotency_key"), F.sha2("text", 256).alias("object_id"))
    return op.imports(requests, entries(spark, sf_dir))


KEY = b"lodestar share key"
_HEX = {pad: bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)}


@query(
    "share_tokens",
    f"""SELECT c_custkey, signature, replace(replace(rtrim(to_base64(unhex(signature)), '='), '+', '-'), '/', '_') AS token FROM (
          SELECT c_custkey, sha256(from_hex('{_HEX[0x5C]}') || from_hex(sha256(from_hex('{_HEX[0x36]}') || encode(c_name)))) AS signature FROM customer)""",
)
def share_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = table(spark, sf_dir, "customer").select("c_custkey", hmac_sha256(KEY, F.col("c_name")).alias("signature"))
    return signed.withColumn("token", base64url(F.unhex("signature")))


@query(
    "share_access",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 100 > 50 THEN 's' || o_orderkey END AS share_id FROM orders""",
)
def share_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as holders of access tokens: some are altered, signed by another key, cut, or expired."""
    key, share = F.col("o_orderkey"), F.concat(F.lit("s"), F.col("o_orderkey"))
    until = key % 100 + 1_700_000_000
    token = access_token(KEY, share, until)
    sent = F.when(key % 7 == 0, F.concat(F.lit("x"), token)).when(key % 11 == 0, access_token(b"another", share, until)).when(key % 13 == 0, F.split_part(token, F.lit("."), F.lit(1))).otherwise(token)
    return table(spark, sf_dir, "orders").select("o_orderkey", accessed_share(KEY, sent, F.lit(1_700_000_050)).alias("share_id"))


@query(
    "processing_lease",
    """SELECT event_id, CASE WHEN event_type = 'view' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 180 SECOND THEN 'busy'
                             WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'current' ELSE 'acquired' END AS lease FROM events""",
)
def processing_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents: views are being processed, purchases are indexed, half of them by the current pipeline."""
    kind = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "indexed").otherwise("failed")
    documents = table(spark, sf_dir, "events").select("event_id", kind.alias("status"), F.col("ts").alias("updated_at"), F.when(F.col("event_id") % 2 == 0, "p2").otherwise("p1").alias("pipeline_version"), F.lit("m1").alias("model_version"))
    return op.leases(documents, F.expr(NOW), "p2", "m1").select("event_id", "lease")


@query(
    "token_family",
    """WITH u AS (SELECT user_id AS family_id, event_id % 50 AS token_id, ts, row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY ts, event_id) AS n FROM events)
       SELECT family_id, min(ts) FILTER (n = 2) AS reused_at, count(DISTINCT token_id) AS revoked FROM u GROUP BY family_id HAVING count(*) FILTER (n = 2) > 0""",
)
def token_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("family_id"), F.pmod("event_id", F.lit(50)).alias("token_id"), F.col("ts").alias("used_at"), F.col("event_id").alias("use_id"))
    return op.token_families(uses)


@query(
    "quota_gauge",
    f"""WITH e AS (SELECT owner_id, sum(size_bytes)::BIGINT AS used_bytes FROM ({ENTRIES_SQL}) WHERE NOT deleted GROUP BY owner_id),
        s AS (SELECT o_custkey % 6 AS owner_id, sum(floor(o_totalprice))::BIGINT AS reserved_bytes FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
        SELECT owner_id, coalesce(used_bytes, 0) AS used_bytes, coalesce(reserved_bytes, 0) AS reserved_bytes, greatest(100000000 - coalesce(used_bytes, 0) - coalesce(reserved_bytes, 0), 0)::BIGINT AS free_bytes FROM e FULL JOIN s USING (owner_id)""",
)
def quota_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as sessions that hold their bytes; two owners have no files."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("uploading")
    sessions = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 6).alias("owner_id"), status.alias("status"), F.floor("o_totalprice").cast("long").alias("reserved_bytes"))
    return op.gauge(entries(spark, sf_dir), sessions, 100_000_000)


@query(
    "share_changes",
    f"""WITH e AS (SELECT DISTINCT owner_id, file_id FROM ({ENTRIES_SQL}) WHERE NOT deleted),
        c AS (SELECT event_id AS command_id, CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'revoke' ELSE event_type END AS kind, user_id % 4 AS owner_id, user_id AS file_id, event_id % 50 AS share_id, ts AS moment,
                CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 1 DAY * (event_id % 5 - 1) END AS expires_at FROM events),
        r AS (SELECT owner_id, share_id, arg_min(command_id, struct_pack(a := moment, c := command_id)) AS first FROM c WHERE kind = 'revoke' GROUP BY ALL),
        v AS (SELECT c.*, CASE kind WHEN 'create' THEN CASE WHEN e.file_id IS NULL THEN 'not_found' WHEN coalesce(expires_at <= moment, false) THEN 'conflict' ELSE 'created' END
                WHEN 'revoke' THEN CASE WHEN c.share_id % 4 = c.owner_id AND c.share_id % 3 <> 0 AND first = command_id THEN 'revoked' ELSE 'not_found' END ELSE 'invalid' END AS verdict
              FROM c LEFT JOIN e ON e.owner_id = c.owner_id AND e.file_id = c.file_id LEFT JOIN r ON r.owner_id = c.owner_id AND r.share_id = c.share_id)
        SELECT command_id, verdict, CASE verdict WHEN 'created' THEN sha256('share:' || command_id) WHEN 'revoked' THEN share_id::VARCHAR END AS share_id FROM v""",
)
def share_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands on the shares 0 to 49, a third of which were revoked before; users share the file with their number."""
    number, ts = F.col("event_id"), F.col("ts")
    kind = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "revoke").otherwise(F.col("event_type"))
    ends = F.when(number % 3 > 0, ts + F.make_dt_interval((number % 5 - 1).cast("int")))
    commands = table(spark, sf_dir, "events").select(number.alias("command_id"), kind.alias("kind"), F.pmod("user_id", F.lit(4)).alias("owner_id"), F.col("user_id").alias("file_id"), (number % 50).alias("share_id"), ts.alias("at"), ends.alias("expires_at"))
    shares = commands.select("share_id").distinct().select("share_id", (F.col("share_id") % 4).alias("owner_id"), F.when(F.col("share_id") % 3 == 0, F.lit("2023-12-01").cast("timestamp_ntz")).alias("revoked_at"))
    return op.share_commands(commands, shares, entries(spark, sf_dir))


@query("newest_shares", "SELECT event_id AS share_id, user_id % 4 AS owner_id, ts AS created_at FROM events WHERE user_id % 4 = 1 ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = table(spark, sf_dir, "events").select(F.col("event_id").alias("share_id"), F.pmod("user_id", F.lit(4)).alias("owner_id"), F.col("ts").alias("created_at"))
    return op.newest_shares(shares, 1)
