"""Streams that wait: delivery at a due time, expiry unless something ends in time, and limits per key and window.

State is kept by Spark (RocksDB) and timers follow the watermark. Rows are dealt into shards by their
id; a shard holds its rows in one list of Arrow pieces and has one timer, for the earliest of them, so a batch costs a few calls of
the state store for a shard and not several for a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 64
#: Requests a minute by scope; scopes that aren't named, and limits that aren't positive, have none.
SCOPE_LIMITS = {"search": 60, "ask": 20, "reprocess": 6}


#: Rows of a piece of a shard's state.
PIECE_ROWS = 1 << 14
PIECES = T.StructType([T.StructField("rows", T.BinaryType())])


def pieces(rows: pd.DataFrame, schema: pa.Schema) -> list[tuple[bytes]]:
    """Rows as values of a list state, many in each."""
    table = pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False)
    return [(_stream(batch),) for batch in table.combine_chunks().to_batches(PIECE_ROWS)]


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def whole(state, schema: pa.Schema) -> pd.DataFrame:
    """The rows of a list state."""
    held = [pa.ipc.open_stream(piece).read_all() for (piece,) in state.get()] if state.exists() else []
    return pa.concat_tables([schema.empty_table(), *held]).to_pandas()


class Waiting(StatefulProcessor):
    """Rows of a shard (``id``, ``at``, ``due``, ``ends``, ``payload``) until the watermark reaches their due time; a row that ends takes its id's row away if it came in time."""

    STATE = pa.schema([("id", pa.string()), ("at", pa.int64()), ("due", pa.int64()), ("ends", pa.bool_()), ("payload", pa.string())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PIECES)

    def _turn(self, rows: pd.DataFrame, now: int) -> pd.DataFrame:
        """Keeps what isn't due and returns what is."""
        rows = rows.sort_values(["id", "at"], kind="stable")
        ends = rows[rows["ends"]].groupby("id")["at"].min()
        starts = rows[~rows["ends"]].drop_duplicates("id")
        ended = starts["id"].map(ends)
        starts = starts[~(ended.notna() & (ended <= starts["due"]))]
        out = starts[starts["due"] <= now]
        # an end waits for its row as long as that may still come
        left = pd.concat([starts[starts["due"] > now], rows[rows["ends"] & (rows["due"] > now)]])
        self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(left):
            self.waiting.put(pieces(left, self.STATE))
            self.handle.registerTimer(int(-(-left["due"].min() // 1000)))
        return out[["id", "due", "payload"]]

    def _held(self) -> pd.DataFrame:
        return whole(self.waiting, self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[self.STATE.names] for r in rows]).astype({"id": str})
        yield self._turn(pd.concat([self._held(), new]), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._turn(self._held(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def waiting(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``id, due, payload`` of rows (``id``, ``ts`` with a watermark, ``due``, ``ends``, ``payload``), each once, when the watermark reaches ``due``.

    A row with ``ends`` cancels the row of its id if its ``ts`` isn't later than that one's due time, whichever comes first; it
    waits for it until its own ``due``. Of rows of one id the earliest counts while it waits.
    """
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    keyed = rows.select(shard, F.col("id").cast("string").alias("id"), "ts", _micros(F.col("ts")).alias("at"), _micros(F.col("due")).alias("due"), "ends", "payload")
    found = keyed.groupBy("shard").transformWithStateInPandas(Waiting(), "id string, due long, payload string", "Append", "EventTime")
    return found.withColumn("due", F.timestamp_micros("due"))


def delayed(tasks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Tasks of a stream (``ts`` with a watermark, ``task_id``, ``available_at`` and more) as they become available: all columns but the payload's own."""
    payload = F.to_json(F.struct(*[c for c in tasks.columns if c not in ("task_id", "available_at", "ts")]))
    rows = tasks.select(F.col("task_id").alias("id"), "ts", F.col("available_at").alias("due"), F.lit(False).alias("ends"), payload.alias("payload"))
    return waiting(rows, shards).select(F.col("id").alias("task_id"), F.col("due").alias("available_at"), "payload")


def expiries(sessions: DataFrame, keep: str = "7 days", shards: int = SHARDS) -> DataFrame:
    """Sessions of a stream that end without completion: of rows ``session_id``, ``ts`` (with a watermark), ``kind`` (created, completed) and ``expires_at`` those
    whose time has passed. A completion that comes before its session's creation is remembered for ``keep``."""
    ends = F.col("kind") == "completed"
    due = F.when(ends, F.col("ts") + F.expr(f"INTERVAL {keep}")).otherwise(F.col("expires_at"))
    rows = sessions.filter(F.col("kind").isin("created", "completed")).select(F.col("session_id").alias("id"), "ts", due.alias("due"), ends.alias("ends"), F.lit(None).cast("string").alias("payload"))
    return waiting(rows, shards).select(F.col("id").alias("session_id"), F.col("due").alias("expired_at"))


class Allowance(StatefulProcessor):
    """The numbers of requests of a shard's users so far, by scope, user and window (``who``); each is forgotten after its life time."""

    STATE = pa.schema([("who", pa.string()), ("n", pa.int64()), ("until", pa.int64())])

    def __init__(self, limits: dict[str, int], life_ms: int):
        self.limits, self.life_ms = limits, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", PIECES)

    def _keep(self, known: pd.DataFrame) -> None:
        self.counts.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(known):
            self.counts.put(pieces(known, self.STATE))
            self.handle.registerTimer(int(known["until"].min()))

    def _known(self, now: int) -> pd.DataFrame:
        known = whole(self.counts, self.STATE)
        return known[known["until"] > now]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
        limit = new["scope"].map(self.limits).fillna(0).clip(lower=0)
        allowed = pd.Series(True, index=new.index)
        held = new.loc[limit > 0, "who"]
        known = self._known(now)
        place = held.groupby(held).cumcount() + 1 + held.map(known.set_index("who")["n"]).fillna(0).astype("int64")
        allowed[held.index] = place <= limit[held.index]
        last = place.groupby(held).max()
        fresh = pd.DataFrame({"who": last.index, "n": last.to_numpy(), "until": now + self.life_ms})
        self._keep(pd.concat([known[~known["who"].isin(fresh["who"])], fresh]))
        yield new[["event_id", "scope", "user_id", "window_start"]].assign(allowed=allowed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(timerValues.getCurrentProcessingTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def stream_limited(requests: DataFrame, limits: dict[str, int] | None = None, width: str = "minute", life: str = "2 minutes", shards: int = SHARDS) -> DataFrame:
    """Requests of a stream (``event_id``, ``scope``, ``user_id``, ``ts``) with ``window_start`` and ``allowed``: the first of each scope, user and window, as many as the scope's limit.

    A count lives for ``life`` of the clock after its last request; rows of a batch count in the order of their times. A user's requests lie in one of the shards.
    """
    life_ms = int(pd.Timedelta(life).total_seconds() * 1000)
    shard = F.pmod(F.xxhash64("scope", "user_id"), F.lit(shards)).cast("int").alias("shard")
    start = F.date_trunc(width, F.col("ts").cast("timestamp"))
    # one text for each scope, user and window, in which nulls and separators can't be mistaken
    parts = [F.unix_micros(start).cast("string"), F.concat(F.length("scope").cast("string"), F.lit(":"), "scope"), F.concat(F.lit(":"), F.col("user_id").cast("string"))]
    who = F.concat(F.coalesce(parts[0], F.lit("-")), F.lit(":"), *[F.coalesce(p, F.lit("-")) for p in parts[1:]])
    keyed = requests.select(shard, "event_id", "scope", "user_id", start.alias("window_start"), F.col("ts").cast("timestamp").alias("ts"), who.alias("who"))
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("event_id", "scope", "user_id", "window_start")) + ", allowed boolean"
    return keyed.groupBy("shard").transformWithStateInPandas(Allowance(SCOPE_LIMITS if limits is None else limits, life_ms), schema, "Append", "ProcessingTime")
