"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed

#: Edges that one task of a round takes. A small graph isn't spread over hundreds of partitions, a large one keeps them.
EDGES_A_TASK = 1 << 19


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Ties every smaller neighbour of a node, and the node, to the smallest of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()


def _least_ends(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node that these edges tie it to: one for each node that isn't the smallest itself."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (apart := (x := label[a]) != (y := label[b])).any():
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := label[label]) != label).any():
            label = up
    tied = np.flatnonzero(label != np.arange(len(ids)))
    return ids[tied], ids[label[tied]]


def _thinned(edges: DataFrame, tasks: int) -> DataFrame:
    """Fewer edges with the same components: those of a task, so many at a time, become one for each of their nodes."""

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def ends() -> pa.RecordBatch:
            part = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _least_ends(part.column("u").to_numpy(), part.column("v").to_numpy())], names=["u", "v"])

        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= 2 * EDGES_A_TASK:
                yield ends()
                held, rows = [], 0
        if rows:
            yield ends()

    return edges.coalesce(tasks).mapInArrow(thinned, edges.schema).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Of each node that has an edge, ``node`` and ``root``, the smallest node that it reaches.

    Self-loops and edges with a null end are left out, repeated edges count once. Each round
    is two joins and two pre-aggregated groupings of the edges, none of which gathers a
    node's neighbours in one row; rounds grow with the logarithm of the longest path. Before the first, a task's edges are
    thinned to one for each node that they tie, as a group that many buckets have found comes with many edges for each of its nodes.
    Every round ends in a checkpoint, so that lost executors cost one round at most. A round has as many tasks
    as its edges ask for, at most those of the shuffle.
    """
    ends = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = checkpointed(ends), None
    if many := now.count():
        now = checkpointed(_thinned(now, -(-many // EDGES_A_TASK)))
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not state.n or state == before:
            break
        tasks = -(-state.n // EDGES_A_TASK)
        tied = _large_star(now.coalesce(tasks), tasks).coalesce(tasks)
        now, before = checkpointed(_small_star(tied, tasks).coalesce(tasks)), state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
