"""The event outbox: routing, deduplication, limits and breakers, on batches and on streams alike.

Functions that take any DataFrame serve both; ``stream_*`` add what a stream needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tasks of each event type: (event type, task, queue, only with the AI process). Others go to maintenance as they are.
ROUTES = (
    ("object.ready.v1", "object.ready.v1", "media", False),
    ("object.ready.v1", "ai.index_requested.v1", "ai", True),
    ("object.gc_requested.v1", "object.gc_requested.v1", "maintenance", False),
    ("object.verify_requested.v1", "object.verify_requested.v1", "object", False),
    ("ai.reprocess_requested.v1", "ai.reprocess_requested.v1", "ai", True),
)
GC_DELAY, MOST_ATTEMPTS = "INTERVAL 24 HOURS", 8
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW_SECONDS, LEAST_REQUESTS, FAILURE_RATE, OPEN_SECONDS, PROBES = 10, 20, 0.5, 5, 3


def fanned_out(events: DataFrame, ai_enabled: bool = True) -> DataFrame:
    """A row per task of each event: the event's columns, ``task_type``, ``queue``, ``task_id`` and ``available_at``."""
    kind = F.col("event_type")
    none = F.array().cast("array<struct<task_type:string,queue:string>>")
    routes = []
    for name in dict.fromkeys(r[0] for r in ROUTES):
        targets = [F.struct(F.lit(t).alias("task_type"), F.lit(q).alias("queue")) for n, t, q, ai in ROUTES if n == name and (ai_enabled or not ai)]
        routes.append(F.when(kind == name, F.array(*targets) if targets else none))
    other = F.array(F.struct(kind.alias("task_type"), F.lit("maintenance").alias("queue")))
    rows = events.withColumn("_t", F.explode(F.coalesce(*routes, other)))
    late = F.when(F.col("_t.task_type") == "object.gc_requested.v1", F.col("ts") + F.expr(GC_DELAY)).otherwise(F.col("ts"))
    return rows.select(*events.columns, "_t.task_type", "_t.queue", F.concat_ws(":", F.col("event_id").cast("string"), "_t.task_type").alias("task_id"), late.alias("available_at"))


def outbox_batch(events: DataFrame, now: Column, size: int = 20) -> DataFrame:
    """The oldest pending events that are available, a batch of them."""
    return events.filter((F.col("status") == "pending") & (F.col("available_at") <= now)).orderBy("created_at", "event_id").limit(size)


def deduplicated(tasks: DataFrame) -> DataFrame:
    """One row per task id, the earliest."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("ts"))
    return tasks.withColumn("_place", place).filter("_place = 1").drop("_place")


def limited(requests: DataFrame, limit: int, width: str = "minute") -> DataFrame:
    """Requests with ``allowed``: the first ``limit`` of a user in each tumbling window; no limit if it isn't positive."""
    start = F.date_trunc(width, "ts")
    if limit <= 0:
        return requests.withColumns({"window_start": start, "allowed": F.lit(True)})
    place = F.row_number().over(Window.partitionBy("user_id", start).orderBy("ts", "event_id"))
    return requests.withColumns({"window_start": start, "allowed": place <= limit})


def window_counts(requests: DataFrame, width: str = "1 day") -> DataFrame:
    """Requests per user and tumbling window."""
    return requests.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def failure_windows(calls: DataFrame, seconds: int = WINDOW_SECONDS, least: int = LEAST_REQUESTS, rate: float = FAILURE_RATE) -> DataFrame:
    """Each call with the ``requests`` and ``failures`` of its key in the seconds up to it, and whether they would open a breaker.

    Time is cut into buckets of ``seconds``. Those seconds are the call's bucket so far, and what the bucket before has counted without the calls that
    have left: running sums of a key and bucket, so a call costs the same however many are in its window, and a busy key is many tasks.
    """
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    timed = calls.withColumns({"_at": at, "_bucket": F.floor(at / seconds), "_n": F.lit(1).cast("long"), "_f": F.when(F.col("success"), 0).otherwise(1).cast("long"), "_own": F.lit(True)})
    sums = [F.sum("_n").alias("_n"), F.sum("_f").alias("_f")]
    counts = timed.filter("_at IS NOT NULL").groupBy("key", "_at", "_bucket").agg(*sums)
    after = F.col("_bucket") + 1
    kept = counts.groupBy("key", after.alias("_bucket")).agg(*sums).withColumn("_at", F.col("_bucket") * seconds)
    left = counts.select("key", after.alias("_bucket"), (F.col("_at") + seconds).alias("_at"), (-F.col("_n")).alias("_n"), (-F.col("_f")).alias("_f"))
    both = timed.unionByName(kept.unionByName(left), allowMissingColumns=True)
    span = Window.partitionBy("key", "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"requests": F.sum("_n").over(span), "failures": F.sum("_f").over(span)}).filter("_own")
    return found.select(*calls.columns, "requests", "failures").withColumn("opens", (F.col("requests") >= least) & (F.col("failures") >= rate * F.col("requests")))


class Breaker:
    """The state of one breaker, stepped by calls in time order; plain values, so a stream can keep it.

    Calls are counted in buckets of time that begin at the first call, and anew when the breaker opens or closes and after
    a pause of the whole window.
    """

    def __init__(self, state: tuple | None = None, seconds: int = WINDOW_SECONDS, buckets: int = 10, least: int = LEAST_REQUESTS, rate: float = FAILURE_RATE, open_seconds: float = OPEN_SECONDS, probes: int = PROBES):
        self.width, self.buckets, self.least, self.rate, self.open_seconds, self.probes = seconds / buckets, buckets, least, rate, open_seconds, probes
        self.state, self.since, self.passed, self.calls, self.start, self.bucket = state or ("closed", 0.0, 0, [], None, 0)

    def turn(self, state: str, at: float) -> None:
        self.state, self.since, self.calls, self.start, self.bucket = state, at, [], at, 0

    def advance(self, at: float) -> None:
        """Moves to the bucket of a time and forgets those that left the window."""
        self.start = at if self.start is None else self.start
        steps = int((at - self.start) / self.width + 1e-9)
        if steps >= self.buckets:
            self.calls, self.start, self.bucket = [], at, 0
        elif steps > 0:
            self.start, self.bucket = self.start + steps * self.width, self.bucket + steps
            self.calls = [c for c in self.calls if c[0] > self.bucket - self.buckets]

    def step(self, at: float, success: bool) -> tuple[bool, str]:
        """Whether a call at a time is let through, and the state after its outcome."""
        self.advance(at)
        if self.state == "open" and at - self.since >= self.open_seconds:
            self.state, self.passed = "half_open", 0
        if self.state == "open":
            return False, self.state
        if self.state == "half_open":
            self.passed += success
            if not success:
                self.turn("open", at)
            elif self.passed >= self.probes:
                self.turn("closed", at)
            return True, self.state
        if not self.calls or self.calls[-1][0] != self.bucket:
            self.calls.append([self.bucket, 0, 0])
        self.calls[-1][1 + (not success)] += 1
        total, failed = sum(c[1] + c[2] for c in self.calls), sum(c[2] for c in self.calls)
        if not success and total >= self.least and failed / total >= self.rate:
            self.turn("open", at)
        return True, self.state


def breaker_states(calls: DataFrame, **config) -> DataFrame:
    """Calls (key, call_id, ts, success) with ``let_through`` and ``state`` of their key's breaker, stepped in time order.

    A key's calls are sequential by nature; they pass a task in batches, sorted by Spark, and
    only the breaker's few counters are held.
    """
    rows = calls.select("key", "call_id", F.col("ts").cast("timestamp").alias("ts"), "success")
    parted = rows.repartition("key").sortWithinPartitions("key", "ts", "call_id")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, breaker = object(), None
        for part in batches:
            out = []
            for k, at, ok in zip(part["key"], part["ts"].astype("int64") / (1e9 if part["ts"].dtype.str.endswith("[ns]") else 1e6), part["success"], strict=True):
                if k != key:
                    key, breaker = k, Breaker(**config)
                out.append(breaker.step(at, bool(ok)))
            yield part[["key", "call_id"]].assign(let_through=[x for x, _ in out], state=[s for _, s in out])

    kind = calls.schema["key"].dataType.simpleString()
    number = calls.schema["call_id"].dataType.simpleString()
    return parted.mapInPandas(step, f"key {kind}, call_id {number}, let_through boolean, state string")


def retry_state(tasks: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Tasks (attempts, failed, permanent) with ``next``: ``done``, ``dead`` or ``retry``."""
    dead = F.col("permanent") | (F.col("attempts") >= most)
    return tasks.withColumn("next", F.when(~F.col("failed"), "done").when(dead, "dead").otherwise("retry"))


def histogram(requests: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """Requests by ``route`` and ``le``, the smallest edge that isn't below their value (null beyond the last)."""
    le: Column = F.lit(None).cast("double")
    for edge in reversed(edges):
        le = F.when(F.col("value") <= edge, F.lit(float(edge))).otherwise(le)
    return requests.groupBy("route", le.alias("le")).agg(F.count("*").alias("n"))


def traced(payload: Column, trace: Column) -> Column:
    """A JSON object with the trace context, itself JSON, merged in under ``_trace`` in place of what is there; other values keep their types.

    A payload that is no object stays as it is, and so does any without a trace context.
    """
    fields = F.from_json(F.when(payload.rlike(r"^\s*\{"), payload), "map<string,variant>", {"mode": "PERMISSIVE"})
    added = F.try_parse_json(trace)
    known = F.when(F.try_parse_json(payload).isNotNull(), fields)
    merged = F.map_concat(F.map_filter(known, lambda k, v: k != "_trace"), F.create_map(F.lit("_trace"), added))
    return F.when(known.isNotNull() & added.isNotNull(), F.to_json(merged)).otherwise(payload)


def stream_of(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8, pattern: str | None = None) -> DataFrame:
    """A stream of the event files in a folder, whose names may have to match ``pattern``; the offsets of the query's checkpoint stand for the outbox's row locks."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def stream_tasks(events: DataFrame, ai_enabled: bool = True, horizon: str = "60 days") -> DataFrame:
    """Tasks of a stream of events, each id once within the horizon; event times are time stamps."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", horizon)
    return fanned_out(timed, ai_enabled).dropDuplicatesWithinWatermark(["task_id"])


def run_to_end(stream: DataFrame, at: str, mode: str = "append", batches: bool = True) -> None:
    """Runs a streaming query over what is there now, into Parquet under ``at``. Its state is kept in RocksDB.

    Without ``batches`` it is one batch: state that lives by the clock asks for empty batches for ever, so such a query wouldn't end by itself.
    """
    conf = stream.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_PROVIDER)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").trigger(**({"availableNow": True} if batches else {"once": True})).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
