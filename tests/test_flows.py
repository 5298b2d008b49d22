"""Folds, providers, streams that wait, and metrics, by hand."""

import datetime
import json

import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.operators import documents, folds, providers, uploads
from lodestar.sources import content
from lodestar.streaming import events, metrics, timers


def test_session_moves(spark):
    log = [(1, 1, "confirm", None), (1, 2, "complete", False), (1, 3, "complete", True), (1, 4, "abort", None), (1, 5, "accept", None), (1, 6, "complete", None), (2, 1, "accept", None), (2, 2, "expire", None), (2, 3, "abort", None), (2, 4, "confirm", None)]
    rows = spark.createDataFrame(log, "session_id int, n int, command string, ready boolean")
    done = {(r.session_id, r.n): (r.to_state, r.reason) for r in folds.transitions(rows, folds.SESSION_MOVES, "created", "session_id", ["n"], "parts_missing").collect()}
    assert [done[1, n] for n in range(1, 7)] == [("uploading", None), ("uploading", "parts_missing"), ("verifying", None), ("verifying", "conflict"), ("completed", None), ("completed", None)]
    assert [done[2, n] for n in range(1, 5)] == [("created", "conflict"), ("expired", None), ("aborted", None), ("aborted", "conflict")]
    assert folds.transitions(rows.limit(0), folds.SESSION_MOVES, "created", "session_id", ["n"]).count() == 0


def test_token_families(spark):
    day = datetime.datetime(2024, 1, 1)
    uses = [("a", 1, 0, 9), ("a", 2, 1, 9), ("a", 3, 0, 9), ("a", 4, 2, 9), ("b", 1, 1, 9), ("b", 2, 0, 0), ("b", 3, 0, 9)]
    rows = spark.createDataFrame([(f, n, day + datetime.timedelta(hours=n), t, day + datetime.timedelta(hours=e)) for f, n, t, e in uses], "family_id string, use_id int, used_at timestamp, token_no int, expires_at timestamp")
    done = {(r.family_id, r.use_id): (r.verdict, r.issued_no) for r in folds.token_rotations(rows).collect()}
    assert [done["a", n] for n in range(1, 5)] == [("rotated", 1), ("rotated", 2), ("reused", None), ("reused", None)]
    assert [done["b", n] for n in range(1, 4)] == [("unknown", None), ("expired", None), ("rotated", 1)]


def test_requests_of_a_batch_see_each_other(spark):
    sha = "a" * 64
    asked = [(1, "n1", sha, 60, "k1"), (2, "N1 ", sha, 10, "k2"), (3, "n3", sha, 50, "k3"), (4, "n3", sha, 40, "k3"), (5, "n5", sha, 40, "k3"), (6, "n6", "x", 1, "k6"), (7, "n7", "b" * 64, 1, "k7")]
    requests = spark.createDataFrame([(i, 1, "f", n, h, s, k) for i, n, h, s, k in asked], "request_id long, owner_id int, folder_id string, name string, sha256 string, size_bytes long, idempotency_key string")
    sessions = spark.createDataFrame([], "owner_id int, idempotency_key string, folder_id string, name string, status string, expires_at timestamp")
    entries = spark.createDataFrame([(1, "f", "old", "b" * 64, 1, False)], "owner_id int, folder_id string, name string, object_id string, size_bytes long, deleted boolean")
    accounts = spark.createDataFrame([(1, 0, 0, 100)], "owner_id int, used_bytes long, reserved_bytes long, quota_bytes long")
    done = uploads.admissions(requests, sessions, entries, accounts)
    rows = {r.request_id: r for r in done.collect()}
    assert [rows[i].decision for i in range(1, 8)] == ["multipart", "name_conflict", "quota_exceeded", "multipart", "replay", "invalid", "quota_exceeded"]
    assert rows[5].session_id == rows[4].session_id and rows[2].session_id is None
    assert [tuple(r) for r in uploads.usage_after(done).collect()] == [(1, 0, 100)]
    started = {r.name: (r.status, r.reserved_bytes, r.part_count) for r in uploads.new_sessions(requests, done).collect()}
    assert started == {"n1": ("created", 60, 1), "n3": ("created", 40, 1)}
    more = spark.createDataFrame([(1, 0, 0, 1000)], accounts.schema)
    files = uploads.new_entries(requests, uploads.admissions(requests, sessions, entries, more)).collect()
    assert [(f.name, f.object_id) for f in files] == [("n7", "b" * 64)]


class Strict:
    model = "strict"

    def embed(self, texts):
        assert len(texts) <= 10
        if "bad" in texts:
            raise OSError("no answer")
        return [[1.0, 2.0]] * len(texts)


def test_provider_batches(spark):
    rows = [("a", i, "bad" if i == 12 else f"t{i}") for i in range(25)] + [("b", i, "x") for i in range(3)]
    chunks = spark.createDataFrame(rows, "object_id string, ordinal int, content string").repartition(5)
    found = providers.embedded(chunks, Strict(), dimension=2)
    codes = {(r.object_id, r.ordinal): r.error_code for r in found.collect()}
    assert len(codes) == 28 and {k for k, v in codes.items() if v} == {("a", i) for i in range(10, 20)}
    assert set(codes.values()) == {None, "ai.embedding_failed"}
    wrong = providers.embedded(chunks.filter("object_id = 'b'"), Strict(), dimension=3)
    assert {r.error_code for r in wrong.collect()} == {"ai.persistence_failed"}
    assert providers.embedded(chunks.limit(0), Strict()).count() == 0
    before = documents.index_outcomes(spark.createDataFrame([("a", 5, "text/plain"), ("b", 5, "text/plain"), ("c", 5, "image/png"), ("d", 5, "text/plain")], "object_id string, size_bytes long, mime_type string"), spark.createDataFrame([], "object_id string, status string, pipeline_version string, model_version string"), "p", "m")
    read = providers.read_outcomes(spark.createDataFrame([(x, 5) for x in "abd"], "object_id string, size_bytes long"), spark.createDataFrame([("a", 5), ("b", 5)], "object_id string, size_bytes long"))
    whole = {r.object_id: (r.outcome, r.error_code) for r in providers.document_outcomes(before, read, providers.embedding_outcomes(found)).collect()}
    assert whole == {"a": ("failed", "ai.embedding_failed"), "b": ("indexed", None), "c": ("unsupported", "ai.unsupported_type"), "d": ("failed", "ai.object_read_failed")}


def test_observed_counts_and_progress(spark, tmp_path):
    rows, seen = metrics.observed(spark.range(10), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 10, "even": 5}
    progress = metrics.ProgressTable()
    spark.streams.addListener(progress)
    spark.range(7).write.parquet(f"{tmp_path}/in")
    events.run_to_end(events.stream_of(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/out")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(progress)
    assert progress.write(spark, f"{tmp_path}/progress") >= 1 and progress.write(spark, f"{tmp_path}/progress") == 0
    assert spark.read.parquet(f"{tmp_path}/progress").agg(F.sum("input_rows")).first()[0] == 7


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_tasks_wait_for_their_time_across_runs(spark, tmp_path):
    source, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "task_id string, ts timestamp, available_at timestamp, queue string"
    feed(spark, source, [("now", at(0), at(0), "q"), ("late", at(1), at(25), "q"), ("late", at(1), at(25), "q")], schema)

    def released():
        events.run_to_end(timers.delayed(events.stream_of(spark, source, schema).withWatermark("ts", "1 hour"), shards=2), out)
        return sorted((r.task_id, json.loads(r.payload)["queue"]) for r in spark.read.parquet(f"{out}/rows").collect())

    assert released() == [("now", "q")]
    feed(spark, source, [("next", at(20), at(20), "p")], schema)
    assert released() == [("now", "q")]
    feed(spark, source, [("end", at(40), at(90), "p")], schema)
    assert released() == [("late", "q"), ("next", "p"), ("now", "q")]


def test_sessions_expire_unless_completed(spark, tmp_path):
    source, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "session_id long, ts timestamp, kind string, expires_at timestamp"
    feed(spark, source, [(1, at(0), "created", at(5)), (2, at(0), "created", at(5)), (3, at(6), "completed", None), (4, at(1), "other", at(2))], schema)

    def expired():
        events.run_to_end(timers.expiries(events.stream_of(spark, source, schema).withWatermark("ts", "2 hours"), shards=1), out)
        return sorted(int(r.session_id) for r in spark.read.parquet(f"{out}/rows").collect())

    assert expired() == []
    feed(spark, source, [(2, at(4.5), "completed", None), (3, at(5), "created", at(9)), (5, at(5), "created", at(6)), (5, at(7), "completed", None)], schema)
    assert expired() == [1]
    feed(spark, source, [(9, at(60), "created", at(70))], schema)
    assert expired() == [1, 5]


def test_limits_by_scope(spark, tmp_path):
    source, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "event_id long, scope string, user_id long, ts timestamp"
    rows = [(i, s, u, at(0) + datetime.timedelta(seconds=i)) for i, (s, u) in enumerate([("ask", 1)] * 3 + [("search", 1)] * 2 + [("free", 1)] * 4 + [("ask", 2)])]
    feed(spark, source, rows, schema)

    def allowed():
        events.run_to_end(timers.stream_limited(events.stream_of(spark, source, schema), {"ask": 2, "search": 1}, life="1 hour", shards=2), out, batches=False)
        return sorted(r.event_id for r in spark.read.parquet(f"{out}/rows").collect() if not r.allowed)

    assert allowed() == [2, 4]
    feed(spark, source, [(20, "ask", 2, at(0)), (21, "ask", 2, at(0)), (22, "ask", 2, at(1))], schema)
    assert allowed() == [2, 4, 21]


def test_windows_cost_no_more_in_a_busy_key(spark):
    """200,000 calls of one key in one window: with a frame summed anew for each call this was 2 * 10^10 steps."""
    rows = spark.range(200_000).select(F.lit(1).alias("key"), F.col("id").alias("call_id"), F.timestamp_seconds(F.col("id") % 1000 + 7_000).alias("ts"), (F.col("id") % 3 > 0).alias("success"))
    found = events.failure_windows(rows, seconds=400, least=5)
    at = {r.s: (r.requests, r.failures, r.n) for r in found.groupBy((F.unix_seconds("ts") - 7_000).alias("s")).agg(F.max("requests").alias("requests"), F.max("failures").alias("failures"), F.countDistinct("requests", "failures").alias("n")).collect()}
    of = {r.s: (r.n, r.f) for r in rows.groupBy((F.unix_seconds("ts") - 7_000).alias("s")).agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("f")).collect()}
    assert at == {s: (*(sum(of[x][k] for x in range(max(0, s - 399), s + 1)) for k in (0, 1)), 1) for s in range(1000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in plan and "_bucket#" in plan


def test_windows_of_calls_without_a_time_or_key(spark):
    rows = [(k, i, t and at(t), i % 2 == 0) for i, (k, t) in enumerate([(1, None), (1, None), (None, 5), (None, 5.5), (1, 5), (1, 15), (1, 14.9), (1, None)])]
    calls = spark.createDataFrame(rows, "key int, call_id int, ts timestamp, success boolean")
    got = {r.call_id: (r.requests, r.failures) for r in events.failure_windows(calls, seconds=36_000, least=2).collect()}
    assert got == {0: (3, 2), 1: (3, 2), 7: (3, 2), 2: (1, 0), 3: (2, 1), 4: (1, 0), 6: (2, 0), 5: (2, 1)}


def test_files_come_in_pieces_by_bytes():
    """A batch of long files is worked on in slices; before, a whole batch of 10,000 rows was copied several times."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([b"x" * (1 if i % 3 else 10_000) for i in range(300)], pa.binary())], names=["k", "content"])
    parts = list(content.pieces([batch], 50_000))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(300)) and max(p.nbytes for p in parts) <= 100_000
    assert [p.num_rows for p in content.pieces([batch.slice(0, 1)], 10)] == [1] and not list(content.pieces([batch.slice(0, 0)], 10))
