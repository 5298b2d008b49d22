"""State that is stepped by ordered rows of a key: admissions, session transitions, rotating tokens.

A key's rows are sequential by their nature. Spark sorts them into a task, they pass it in batches, and only the state
of one key is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, tuple]], added: str) -> DataFrame:
    """``rows`` with the columns ``added`` (a schema): ``step`` takes a key's state and a row, in order, and gives the next state and the row's new values."""
    more = T.StructType.fromDDL(added) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(added)
    kinds = [to_arrow_type(f.dataType) for f in more.fields]
    names = [f.name for f in more.fields]
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                state, values = step(state, row)
                out.append(values)
            arrays = [pa.array([v[i] for v in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return sorted_rows.mapInArrow(folded, T.StructType([*rows.schema.fields, *more.fields]))


#: Moves of upload sessions by state and command. A move to the same state changes nothing.
SESSION_MOVES = (
    ("created", "confirm", "uploading"),
    ("uploading", "confirm", "uploading"),
    ("created", "complete", "verifying"),
    ("uploading", "complete", "verifying"),
    ("verifying", "complete", "verifying"),
    ("completed", "complete", "completed"),
    ("created", "abort", "aborted"),
    ("uploading", "abort", "aborted"),
    ("expired", "abort", "aborted"),
    ("aborted", "abort", "aborted"),
    ("failed", "abort", "failed"),
    ("created", "expire", "expired"),
    ("uploading", "expire", "expired"),
    ("verifying", "accept", "completed"),
    ("verifying", "reject", "failed"),
)
#: Moves of stored objects; both need that nothing refers to the object.
OBJECT_MOVES = (("ready", "collect", "deleting"), ("deleting", "collect", "deleting"), ("deleting", "finish", "deleted"))


def transitions(log: DataFrame, moves: tuple[tuple[str, str, str], ...], first: str, key: str, order: list[str], refusal: str = "not_ready") -> DataFrame:
    """A log of commands (``key``, ``command``, ``ready`` and the columns of ``order``) with ``from_state``, ``to_state``, ``accepted`` and ``reason``.

    A command that isn't among the moves from a state is refused as a ``conflict``, one that is, but not ``ready`` (false; null counts as
    ready), as ``refusal``; either leaves the state. A command that an end state absorbs is accepted and changes nothing.
    """
    table = {(a, b): c for a, b, c in moves}

    def step(state: str, row: dict) -> tuple[str, tuple]:
        to = table.get((state, row["command"]))
        if to is None:
            return state, (state, state, False, "conflict")
        if to != state and row["ready"] is False:
            return state, (state, state, False, refusal)
        return to, (state, to, True, None)

    return ordered_fold(log, key, order, lambda: first, step, "from_state string, to_state string, accepted boolean, reason string")


def token_rotations(uses: DataFrame, now: Column | None = None) -> DataFrame:
    """Uses of refresh tokens (``family_id``, ``use_id``, ``used_at``, ``token_no``, and ``expires_at`` if tokens end) with ``verdict`` and ``issued_no``.

    A family begins with token 0. Its current token is ``rotated`` into the next one; one that was rotated before is ``reused``, which revokes the
    whole family, so that every later use is ``reused`` too; an expired one is ``expired``, and a number that was never issued is ``unknown``.
    """
    rows = uses.withColumn("_late", F.coalesce(F.col("expires_at") <= F.col("used_at"), F.lit(False)) if "expires_at" in uses.columns else F.lit(False))

    def step(state: tuple[int, bool], row: dict) -> tuple[tuple[int, bool], tuple]:
        current, alive = state
        if row["token_no"] is None or row["token_no"] > current or row["token_no"] < 0:
            return state, ("unknown", None)
        if row["token_no"] < current or not alive:
            return (current, False), ("reused", None)
        if row["_late"]:
            return state, ("expired", None)
        return (current + 1, True), ("rotated", current + 1)

    return ordered_fold(rows, "family_id", ["used_at", "use_id"], lambda: (0, True), step, "verdict string, issued_no long").drop("_late")
