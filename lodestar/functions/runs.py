"""Whole runs of sorted Arrow batches, and compact arrays of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(part: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row begins a run of equal ``columns``; the first row always does."""
    new = np.ones(part.num_rows, dtype=bool)
    if part.num_rows > 1:
        differs = np.zeros(part.num_rows - 1, dtype=bool)
        for name in columns:
            values = part.column(name).combine_chunks()
            differs |= pc.fill_null(pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)), True).to_numpy(zero_copy_only=False)
        new[1:] = differs
    return new


def whole_runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a run of equal ``columns`` ends; rows must be sorted by them and have no nulls there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        part = pa.Table.from_batches(held)
        last = int(np.flatnonzero(changes(part, columns))[-1])
        if last:
            yield part.slice(0, last).combine_chunks()
            held = part.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of one, two, four or eight bytes, after a byte that names the width."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def packed_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``packed`` for each of many runs that follow each other from the first value to the last, all at once."""
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    width = np.full(len(starts), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(1 + sizes * width)])
    data = np.zeros(offsets[-1], np.uint8)
    data[offsets[:-1]] = width
    of = np.repeat(width, sizes)
    at = np.repeat(offsets[:-1] + 1 - starts * width, sizes) + np.arange(len(values)) * of
    for w in (1, 2, 4, 8):
        some = np.flatnonzero(of == w)
        if len(some):
            data[at[some][:, None] + np.arange(w)] = values[some].astype(f"<i{w}").view(np.uint8).reshape(-1, w)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)
