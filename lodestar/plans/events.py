"""The outbox over the event table, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.checkpoints import is_folder, stream_dir
from lodestar.plans.registry import query
from lodestar.sources.drive import table
from lodestar.streaming import events as op
from lodestar.streaming import timers

#: Event types of the table as those of the outbox.
KINDS = {"signup": "file.created.v1", "purchase": "object.ready.v1", "click": "object.verify_requested.v1", "view": "share.imported.v1", "error": "object.gc_requested.v1"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " ELSE event_type END"


def renamed(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    return events.withColumn("event_type", kind)


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(table(spark, sf_dir, "events"))


FANOUT_SQL = f"""
    WITH e AS (SELECT event_id, ts, {KIND_SQL} AS event_type FROM events),
         t AS (SELECT *, unnest(CASE event_type WHEN 'object.ready.v1' THEN ['object.ready.v1', 'ai.index_requested.v1'] ELSE [event_type] END) AS task_type FROM e)
    SELECT event_id, task_type,
           CASE task_type WHEN 'object.ready.v1' THEN 'media' WHEN 'ai.index_requested.v1' THEN 'ai' WHEN 'object.verify_requested.v1' THEN 'object' ELSE 'maintenance' END AS queue,
           event_id || ':' || task_type AS task_id, CASE WHEN task_type = 'object.gc_requested.v1' THEN ts + INTERVAL 24 HOUR ELSE ts END AS available_at FROM t"""
FANOUT = ["event_id", "task_type", "queue", "task_id", "available_at"]


@query("event_fanout", FANOUT_SQL)
def event_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fanned_out(outbox(spark, sf_dir)).select(FANOUT)


@query("event_dedupe", FANOUT_SQL)
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice: each task stays once."""
    events = outbox(spark, sf_dir)
    return op.deduplicated(op.fanned_out(events.unionByName(events))).select(FANOUT)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: a file or a folder of files."""
    schema = table(spark, sf_dir, "events").schema
    if is_folder(spark, f"{sf_dir}/events.parquet"):
        return op.stream_of(spark, f"{sf_dir}/events.parquet", schema)
    return op.stream_of(spark, sf_dir, schema, pattern="events.parquet")


@query("stream_fanout", FANOUT_SQL)
def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the event file, to its end; tasks are deduplicated in state."""
    at = stream_dir(spark, "fanout")
    op.run_to_end(op.stream_tasks(renamed(event_stream(spark, sf_dir))).select(FANOUT), at)
    return spark.read.parquet(f"{at}/rows").withColumn("available_at", F.col("available_at").cast("timestamp_ntz"))


@query("stream_delayed", f"SELECT task_id, available_at, queue FROM ({FANOUT_SQL}) WHERE available_at <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a stream as they become available by the watermark, a day behind the last event; those for later wait on."""
    at = stream_dir(spark, "delayed")
    tasks = op.stream_tasks(renamed(event_stream(spark, sf_dir)), horizon="1 day").select("ts", "task_id", "queue", "available_at")
    op.run_to_end(timers.delayed(tasks), at)
    rows = spark.read.parquet(f"{at}/rows")
    return rows.select("task_id", F.col("available_at").cast("timestamp_ntz").alias("available_at"), F.get_json_object("payload", "$.queue").alias("queue"))


@query(
    "stream_expiry",
    """WITH s AS (SELECT o_orderkey AS session_id, o_orderdate AS ts, o_orderdate + INTERVAL 1 DAY AS due,
                CASE WHEN o_orderstatus = 'F' THEN o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 30 HOUR ELSE INTERVAL 1 HOUR END END AS done FROM orders)
       SELECT session_id, due AS expired_at FROM s WHERE NOT coalesce(done <= due, false) AND due <= (SELECT greatest(max(ts), max(done)) - INTERVAL 1 DAY FROM s)""",
)
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream that aren't completed within a day: filled orders are, an hour later, or thirty hours later, which is too late."""
    at = stream_dir(spark, "expiry")
    schema = table(spark, sf_dir, "orders").schema
    folder = is_folder(spark, f"{sf_dir}/orders.parquet")
    orders = op.stream_of(spark, f"{sf_dir}/orders.parquet", schema) if folder else op.stream_of(spark, sf_dir, schema, pattern="orders.parquet")
    start = F.col("o_orderdate").cast("timestamp")
    done = start + F.when(F.col("o_orderkey") % 5 == 0, F.expr("INTERVAL 30 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    one = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("ts"))
    steps = F.when(F.col("o_orderstatus") == "F", F.array(one("created", start), one("completed", done))).otherwise(F.array(one("created", start)))
    rows = orders.select(F.col("o_orderkey").alias("session_id"), (start + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.explode(steps).alias("e")).select("session_id", "expires_at", "e.kind", "e.ts")
    op.run_to_end(timers.expiries(rows.withWatermark("ts", "1 day")), at)
    return spark.read.parquet(f"{at}/rows").select(F.col("session_id").cast("long").alias("session_id"), F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))


LIMITS = {"view": 2, "click": 1, "purchase": 0}


@query(
    "stream_limits",
    f"""SELECT event_id, event_type AS scope, user_id, date_trunc('day', ts)::TIMESTAMP AS window_start,
        coalesce(row_number() OVER (PARTITION BY event_type, user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= CASE event_type WHEN 'view' THEN {LIMITS['view']} WHEN 'click' THEN {LIMITS['click']} END, true) AS allowed FROM events""",
)
def stream_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests limited by scope, user and day; the event's type is the scope, and some scopes have no limit."""
    at = stream_dir(spark, "limits")
    requests = event_stream(spark, sf_dir).select("event_id", F.col("event_type").alias("scope"), "user_id", "ts")
    op.run_to_end(timers.stream_limited(requests, LIMITS, "day", "1 hour"), at, batches=False)
    return spark.read.parquet(f"{at}/rows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


COUNT_SQL = "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL"


@query("request_windows", COUNT_SQL)
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.window_counts(table(spark, sf_dir, "events"))


@query("stream_windows", COUNT_SQL)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream; windows are emitted once the watermark has passed, so a second run, after the first has ended, brings a closing event far ahead."""
    at = stream_dir(spark, "windows")
    spark.createDataFrame([], "user_id long, ts timestamp").write.parquet(f"{at}/closing")
    events = event_stream(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    closing = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{at}/closing")
    counts = op.window_counts(events.unionByName(closing).withWatermark("ts", "400 days"))
    op.run_to_end(counts, at)
    spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.expr("TIMESTAMP '9000-01-01'").alias("ts")).write.mode("append").parquet(f"{at}/closing")
    op.run_to_end(counts, at)
    rows = spark.read.parquet(f"{at}/rows").filter("user_id IS NOT NULL")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "rate_limit",
    """SELECT event_id, user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""",
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.limited(table(spark, sf_dir, "events"), 2, "day").select("event_id", "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "allowed")


CALLS_SQL = "SELECT user_id % 10 AS key, event_id, ts, event_type <> 'error' AS success FROM events"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(10)).alias("key"), F.col("event_id").alias("call_id"), "ts", (F.col("event_type") != "error").alias("success"))


@query(
    "breaker_windows",
    f"""WITH c AS ({CALLS_SQL}), w AS (SELECT event_id AS call_id, count(*) OVER r AS requests, count(*) FILTER (NOT success) OVER r AS failures FROM c
        WINDOW r AS (PARTITION BY key ORDER BY epoch(ts)::BIGINT - CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END RANGE BETWEEN 35999 PRECEDING AND CURRENT ROW))
        SELECT call_id, requests, failures, requests >= 5 AND failures >= 0.5 * requests AS opens FROM w""",
)
def breaker_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.failure_windows(calls(spark, sf_dir), seconds=36_000, least=5).select("call_id", "requests", "failures", "opens")


@query("breaker_states")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full state machine; sequential per key, so no SQL. Tests hold it against a plain loop."""
    return op.breaker_states(calls(spark, sf_dir), seconds=36_000, least=5, open_seconds=18_000)


@query(
    "outbox_batch",
    f"""SELECT event_id, {KIND_SQL} AS event_type FROM events WHERE event_id % 3 <> 0 AND ts <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 20""",
)
def outbox_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox(spark, sf_dir).withColumns({"status": F.when(F.col("event_id") % 3 == 0, "published").otherwise("pending"), "created_at": F.col("ts"), "available_at": F.col("ts")})
    return op.outbox_batch(rows, F.expr("TIMESTAMP_NTZ '2024-01-15'")).select("event_id", "event_type")


@query(
    "request_histogram",
    """SELECT event_type AS route, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 5 THEN 5.0 WHEN value <= 20 THEN 20.0 WHEN value <= 100 THEN 100.0 END::DOUBLE AS le, count(*) AS n FROM events GROUP BY ALL""",
)
def request_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram(table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "value"), (1, 5, 20, 100))


@query(
    "retry_states",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 11 = 0 OR event_id % 10 >= 8 THEN 'dead' ELSE 'retry' END AS next FROM events""",
)
def retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 11 == 0).alias("permanent"), (F.col("event_id") % 10).alias("attempts"))
    return op.retry_state(tasks).select("event_id", "next")


@query(
    "traced_payloads",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || event_id || ']' WHEN 1 THEN '{"n":' || event_id || ',"o":{"x":[1,2.5,null]},"b":true,"s":"' || event_type || '"}'
                WHEN 2 THEN '{"n":' || event_id || ',"_trace":{"id":"' || event_id || '"}}'
                ELSE '{"n":' || event_id || ',"o":{"x":[1,2.5,null]},"b":true,"s":"' || event_type || '","_trace":{"id":"' || event_id || '"}}' END AS payload FROM events""",
)
def traced_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole payloads: lists, objects of every type with and without a trace context, and objects that have one already."""
    n, kind = F.col("event_id").cast("string"), F.col("event_id") % 5
    whole = F.concat(F.lit('{"n":'), n, F.lit(',"o":{"x":[1,2.5,null]},"b":true,"s":"'), "event_type", F.lit('"}'))
    old = F.concat(F.lit('{"_trace":"old","n":'), n, F.lit("}"))
    payload = F.when(kind == 0, F.concat(F.lit("["), n, F.lit("]"))).when(kind == 2, old).otherwise(whole)
    trace = F.when(kind != 1, F.concat(F.lit('{"id":"'), n, F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", op.traced(payload, trace).alias("payload"))
