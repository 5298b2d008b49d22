"""Groups of linked nodes inside buckets, in rounds: centres first, so that a large group costs a multiple of its size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import release, written
from lodestar.llm.components import connected_components

#: Bytes of shingles that a task compares (asking texts) with those of a block (all texts).
ASKING_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20


def centred(state: DataFrame, number: int, orders: int) -> DataFrame:
    """Pairs ``a, b`` of a set and a centre in another component that shares a bucket: one for each of ``orders`` random orders at most."""
    ranks = [F.xxhash64(F.lit(number * 8 + j), "node") for j in range(orders)]
    firsts = [F.min(F.struct(r.alias("rank"), F.col("node").alias("centre"), F.col("root").alias("of"))).alias(f"c{j}") for j, r in enumerate(ranks)]
    centres = state.groupBy("key").agg(*firsts)
    near = state.join(centres, "key")
    best = near.groupBy("node").agg(*[F.min(F.when(F.col(f"c{j}.of") != F.col("root"), F.col(f"c{j}"))).alias(f"c{j}") for j in range(orders)])
    found = best.select("node", F.explode(F.array(*[F.col(f"c{j}.centre") for j in range(orders)])).alias("centre")).filter("centre IS NOT NULL")
    return found.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """``labels`` (node, root) after the links, and how many components have merged into others."""
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    moved = connected_components(links.join(a, "a").join(b, "b").select("ra", "rb"), "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("_to"))
    merged = moved.filter("root <> _to").count()
    if not merged:
        return labels, 0
    return written(labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "labels"), merged


def still_open(state: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """Buckets that lie in two components or more, with their rows' ``root``; the number of rows, and of pairs of different components."""
    rows = state.select("key", "node").join(labels, "node")
    spans = rows.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("key")
    still = written(rows.join(spans, "key").select("key", "node", "root"), "open-buckets")
    sizes = still.groupBy("key", "root").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    at = sizes.agg(F.sum("s").alias("rows"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")).first()
    return still, int(at.rows or 0), int(at.pairs or 0)


def core_sizes(sets: DataFrame) -> DataFrame:
    """``node`` and ``core``, how many of its ``shingles`` another of the sets has too: no two sets have more in common than the smaller core.

    Counted by shingle: a shingle that many sets share is a count, never a list of them.
    """
    each = sets.select("node", F.explode("shingles").alias("x"))
    shared = each.groupBy("x").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo <> _hi").select("x")
    held = each.join(shared, "x").groupBy("node").agg(F.count("*").alias("core"))
    return sets.select("node").join(held, "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))


def rounds(state: DataFrame, likely: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame], focus: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Links found by comparing each node with centres of its buckets, round by round: ``labels`` (node, root), the rows of
    ``state`` (key, node, root) in buckets of several components that are left, and the number of their pairs of different components.

    ``likely`` drops pairs that can't be links, ``links`` confirms. After the first round ``focus`` may drop rows of nodes that can't
    have links among those left, and give a sharper ``likely``. It ends when few pairs are left or centres find few links; the
    pairs that are left are the caller's to compare, so the number of rounds decides nothing.
    """
    labels, number = written(state.select("node").distinct().withColumn("root", F.col("node")), "labels"), 0
    state = state.select("key", "node").withColumn("root", F.col("node"))
    while True:
        pairs = written(likely(centred(state, number, 1 if number == 0 else 3)), "pairs")
        release(pairs.sparkSession)
        labels, joined = merged(labels, written(links(pairs), "links"))
        release(pairs.sparkSession)
        state, size, left = still_open(state, labels)
        release(pairs.sparkSession)
        number += 1
        if not left:
            return labels, state, left
        if number == 1 and focus is not None:
            state, likely = focus(state)
        elif left <= 2 * size or 20 * joined < pairs.count():
            return labels, state, left


def outside_links(rows: DataFrame, accept: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Links ``a, b`` of different components inside each ``key``, by whole sets; ``rows`` has ``key``, ``node``, ``root`` and ``shingles`` (and ``prints``, where ``near`` compares them).

    In a pair of different components one node isn't in the largest of its key. Such nodes ask, in blocks by bytes, and all are told in
    blocks by bytes: a key that is one large component with few nodes outside is sent about once. Pairs are compared where they meet, and only
    links leave a task, of each asking node one for each component. ``accept`` decides by the common number and both sizes.
    """
    weight = (F.size("shingles") * 8 + 64).cast("long")
    known = rows.withColumn("_w", weight)
    sizes = known.groupBy("key", "root").agg(F.sum("_w").alias("w"))
    tall = sizes.groupBy("key").agg(F.max_by("root", F.struct("w", "root")).alias("most"), F.sum("w").alias("whole"), (F.sum("w") - F.max("w")).alias("others")).filter("others > 0")
    known = known.join(tall, "key").withColumn("blocks", F.ceil(F.col("whole") / BLOCK_BYTES).cast("int")).withColumn("turns", F.ceil(F.col("others") / ASKING_BYTES).cast("int"))
    asks = known.filter("root <> most").withColumns({"turn": F.pmod(F.xxhash64("node"), F.col("turns")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)})
    told = known.withColumns({"block": F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"), "turn": F.explode(F.sequence(F.lit(0), F.col("turns") - 1)), "asks": F.lit(False)})
    cell = ["key", "turn", "block"]
    names = [*cell, "asks", *[c for c in rows.columns if c != "key"]]
    both = asks.select(*names).unionByName(told.select(*names))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches, cell):
            found = _cell_links(part, accept, near)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return both.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compared, "a long, b long").distinct()


def _cells(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[pa.Table]:
    """One table for each cell of sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in cell])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and any(held[0].column(c)[0] != batch.column(c)[i] for c in cell):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _cell_links(part: pa.Table, accept: Callable, near: Callable | None) -> np.ndarray:
    """Links (2 x links) between the asking rows and the others of a cell."""
    part = part.combine_chunks()
    node, root, ask = (part.column(c).to_numpy() for c in ("node", "root", "asks"))
    lists = part.column("shingles").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    bits = np.stack(part.column("prints").to_numpy()).view(np.uint64) if near is not None else None
    known = np.unique(flat[ask[row]])
    place = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
    hit = known[place] == flat if len(known) else np.zeros(len(flat), bool)
    told = hit & ~ask[row]
    told_row, told_place = row[told], place[told]
    starts, out = np.concatenate([[0], np.cumsum(sizes)]), []
    marks = np.zeros(len(known), bool)
    for i in np.flatnonzero(ask).tolist():
        own = place[starts[i] : starts[i + 1]]
        marks[own] = True
        common = np.bincount(told_row[marks[told_place]], minlength=len(sizes))
        marks[own] = False
        at = np.flatnonzero(~ask & (root != root[i]) & (common > 0))
        at = at[accept(common[at], sizes[at], sizes[i])]
        if near is not None and len(at):
            at = at[near(bits[at], bits[i])]
        if len(at):
            at = at[np.unique(root[at], return_index=True)[1]]
            out.append(np.stack([np.minimum(node[at], node[i]), np.maximum(node[at], node[i])]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
