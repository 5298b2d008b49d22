"""MinHash near-duplicates with tensored banding.

Two collections of ``HALVES`` half keys, of ``WIDTH`` minhashes each, are computed for every distinct shingle set;
a table's key is a pair of one half key of each, so ``HALVES ** 2`` tables cost ``2 * HALVES * WIDTH`` minhashes, about the
square root of what independent tables would. A table key that two sets share needs both halves shared, so half keys
that occur once go before the pairs are formed.

Sets that share a key of a table are candidates, and whole sets confirm links. Groups are found in rounds: each set
is compared with one of its buckets' centres (later with three), links merge components, and buckets that lie in one component are
done. So a group of near copies costs a multiple of its size. Of the sets that then remain it is counted how many shingles each has
in common with any other: that bounds what a pair can share, and many texts with too many edits go by it. Pairs of small buckets
that sketches leave possible are then compared by their whole sets; in large buckets the sets outside of its largest component meet all others in blocks, and only links leave
the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import free_names, release, slices, written
from lodestar.llm.rounds import core_sizes, merged, outside_links, rounds
from lodestar.llm.simhash import _P1, _P4, _mixed, _run_hashes, _runs, _word_hashes, distinct_hashes

#: At a similarity of 0.8 a pair shares no table with a probability of 2 * (1 - 0.8**3)**12, under 0.0004.
HALVES, WIDTH = 12, 3
#: Bytes of a sketch: of the hashes with a common beginning the smallest one's next byte.
BINS = 256
#: Standard deviations that an estimate by sketches may lie below the threshold before a pair is left out (one in 100,000).
SLACK = 4.3
#: Rows of a bucket whose pairs are formed; larger ones are compared in place.
SMALL_BUCKET = 16
#: Hashes that stay in cache while all minhashes of them are taken.
CACHED = 1 << 15


def shingle_sets(texts: pa.Array, shingle: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    offsets, h = _word_hashes(texts)
    return distinct_hashes(*_run_hashes(h, offsets, shingle))


def half_keys(flat: np.ndarray, counts: np.ndarray, halves: int = HALVES, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """``2 * halves`` keys of each set (rows x keys), each of ``width`` minhashes and its own number; sets must not be empty."""
    out = np.empty((len(counts), 2 * halves), np.uint64)
    factors = _mixed(np.arange(1, 2 * halves * width + 1, dtype=np.uint64) * _P4 + np.uint64(seed)) | np.uint64(1)
    ends, row = np.cumsum(counts), 0
    while row < len(counts):
        first = int(ends[row] - counts[row])
        stop = max(row + 1, int(np.searchsorted(ends, first + CACHED, side="right")))
        part = flat[first : ends[stop - 1]]
        starts, turned = (ends - counts)[row:stop] - first, np.empty_like(part)
        for k in range(2 * halves):
            key = np.full(stop - row, k, np.uint64)
            for factor in factors[k * width : (k + 1) * width]:
                np.multiply(part, factor, out=turned)
                key = _mixed(key * _P1 + np.minimum.reduceat(turned, starts))
            out[row:stop, k] = key
        row = stop
    return out


def sketches(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A byte for each bin of each set: 0 if the bin is empty, else from its smallest hash (rows x BINS)."""
    out = np.zeros((len(counts), BINS), np.uint8)
    rows, bins = np.repeat(np.arange(len(counts)), counts), (flat >> np.uint64(56)).astype(np.int64)
    place = rows * BINS + bins
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out.ravel()[place[first]] = 1 + ((flat[first] >> np.uint64(40)) & np.uint64(255)) % np.uint64(255)
    return out


def maybe_similar(a: np.ndarray, b: np.ndarray, whole: np.ndarray, least: int) -> np.ndarray:
    """Whether sketches (rows x BINS) of sets with ``whole`` elements together leave it possible that they share ``least`` percent of their union.

    The bins in use are a sample of the union without repetition, so the estimate of sets with few elements is nearly exact.
    """
    either = ((a | b) > 0).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    p = least / 100
    union = np.maximum(whole / (1 + p), either)
    rest = (union - either) / np.maximum(union - 1, 1)
    return equal >= p * either - 1 - SLACK * np.sqrt(p * (1 - p) * either * rest)


def _matrix(column: pa.Array | pa.ChunkedArray | pd.Series) -> np.ndarray:
    values = column.to_pylist() if not isinstance(column, pd.Series) else column
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, BINS)


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows (key, node, ...) whose key has two nodes or more."""
    shared = rows.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo <> _hi").select("key")
    return rows.join(shared, "key")


def buckets(nodes: DataFrame, halves: int = HALVES) -> DataFrame:
    """``key, half, node`` of the tables' buckets that hold two sets or more; ``nodes`` has ``node`` and its half ``keys``."""
    each = _repeated(nodes.select("node", F.posexplode("keys").alias("slot", "key")))
    sides = each.groupBy("node").agg(F.collect_list(F.when(F.col("slot") < halves, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("slot") >= halves, F.col("key"))).alias("b"))
    pairs = sides.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b"))
    return _repeated(pairs.select(F.xxhash64("a", "b").alias("key"), F.col("a").alias("half"), "node"))


class _Search:
    """The tables that rounds share: nodes (node, n, core, sketch) and sets (node, shingles); ``core`` is how many shingles a set can have in common with another at most."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, least: int):
        self.nodes, self.sets, self.least = nodes.withColumn("core", F.col("n")).select("node", "n", "core", "sketch"), sets, least

    def focused(self, state: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """From now on sets are bound by what they share with those in the rows left; rows of sets that share too little with all of them go."""
        cores = core_sizes(self.sets.join(state.select("node").distinct(), "node", "left_semi"))
        able = self.nodes.drop("core").join(cores, "node").filter(100 * F.col("core") >= self.least * F.col("n"))
        self.nodes = written(able.select("node", "n", "core", "sketch"), "cores")
        return written(state.join(self.nodes.select("node"), "node", "left_semi"), "open-buckets"), self.likely

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs that numbers and sketches leave possible."""
        least = self.least

        @F.pandas_udf("boolean")
        def may(a: pd.Series, b: pd.Series, whole: pd.Series) -> pd.Series:
            return pd.Series(maybe_similar(_matrix(a), _matrix(b), whole.to_numpy(), least)) if len(a) else pd.Series([], dtype=bool)

        a = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("core").alias("ac"), F.col("sketch").alias("as"))
        b = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("core").alias("bc"), F.col("sketch").alias("bs"))
        most = F.least("ac", "bc")
        near = pairs.join(a, "a").join(b, "b").filter(100 * most >= least * (F.col("an") + F.col("bn") - most))
        return near.filter(may("as", "bs", F.col("an") + F.col("bn"))).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs those whose whole sets share ``least`` percent of their union."""
        a = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        b = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        whole = F.size("sa") + F.size("sb") - F.col("common")
        return both.filter(100 * F.col("common").cast("long") >= self.least * whole.cast("long")).select("a", "b")

    def rest(self, state: DataFrame, halves: DataFrame) -> DataFrame:
        """Links of different components that share a bucket. Pairs of small buckets are formed where sketches allow it, and confirmed by whole sets.

        The nodes of a larger bucket are compared by whole sets at once, together with those of other large buckets that have its first half key
        (``halves``: key, half): a set is then sent once for a half key, not for every table.
        """
        sizes = written(state.groupBy("key").agg(F.count("*").alias("_size")), "sizes")
        small = state.join(sizes.filter(F.col("_size") <= SMALL_BUCKET), "key").join(self.nodes, "node")
        found = self.links(written(self._small(small), "pairs"))
        large = sizes.filter(F.col("_size") > SMALL_BUCKET).select("key")
        if large.isEmpty():
            return found
        met = state.join(large, "key").join(halves, "key").select(F.col("half").alias("key"), "node", "root").distinct()
        least = self.least
        return found.unionByName(outside_links(met.join(self.sets, "node"), lambda common, n, own: 100 * common >= least * (n + own - common)))

    def _small(self, rows: DataFrame) -> DataFrame:
        cell, least = ["key"], self.least

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, run in _runs(batches, cell):
                node, root, n, core = (part.column(c).to_numpy() for c in ("node", "root", "n", "core"))
                bits, left, out = _matrix(part.column("sketch")), np.arange(part.num_rows), []
                for step in range(1, part.num_rows):
                    left = left[left + step < part.num_rows]
                    left = left[run[left] == run[left + step]]
                    if not len(left):
                        break
                    i = left[root[left] != root[left + step]]
                    most = np.minimum(core[i], core[i + step])
                    i = i[100 * most >= least * (n[i] + n[i + step] - most)]
                    if len(i):
                        i = i[maybe_similar(bits[i], bits[i + step], n[i] + n[i + step], least)]
                        out.append(np.stack([node[i], node[i + step]]))
                found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=0)), pa.array(found.max(axis=0))], names=["a", "b"])

        return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compared, "a long, b long").distinct()


def _hashed(docs: DataFrame, id_column: str, text: str, shingle: int, halves: int, width: int, seed: int) -> DataFrame:
    """Of each row: ``id``, ``text_key``, ``n`` and, unless the set is empty, its ``digest``, half ``keys`` and ``sketch``."""
    body = docs.select(_col(id_column).cast("long").alias("id"), _text_key(text), _col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, counts = shingle_sets(batch.column("text"), shingle)
            full = np.flatnonzero(counts)
            keys, bits = half_keys(flat, counts[full], halves, width, seed).view(np.int64), sketches(flat, counts[full])
            ends, at = np.cumsum(counts), {int(r): k for k, r in enumerate(full)}
            digests = [hashlib.blake2b(flat[ends[r] - counts[r] : ends[r]].tobytes(), digest_size=16).digest() if r in at else None for r in range(len(counts))]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(counts > 0, 2 * halves, 0))]).astype(np.int32), keys.ravel())
            parts = [bits[at[r]].tobytes() if r in at else None for r in range(len(counts))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(parts, pa.binary())], names=["id", "text_key", "n", "digest", "keys", "sketch"])

    return body.mapInArrow(hashed, "id long, text_key binary, n long, digest binary, keys array<long>, sketch binary")


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(_col(text), F.lit("")).cast("binary"))).alias("text_key")


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes, each from one row (``id``, ``text_key``) that has its set."""
    body = docs.select(_col(id_column).cast("long").alias("id"), _text_key(text), _col(text).alias("text"))
    heads = wanted.select("node", F.col("head.id").alias("_id"), F.col("head.text_key").alias("_key"))
    once = body.join(heads, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select("node", "text").dropDuplicates(["node"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, counts = shingle_sets(batch.column("text"), shingle)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, flat.view(np.int64))], names=["node", "shingles"])

    return once.mapInArrow(made, "node long, shingles array<long>")


def minhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 2, least: int = 80, halves: int = HALVES, width: int = WIDTH, seed: int = 42) -> DataFrame:
    """Of each row: its id (a whole number), ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` (it is that id).

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a set holds the distinct ``shingle``-word shingles, of a text with
    fewer words the whole sequence. Two rows are linked if ``least`` percent of the union of their sets are common; rows with equal sets are
    one node. A row without words or text has an empty set and is linked with nothing: its component is its own id. Repeated rows stay, each with
    its group's id. A null id counts for nothing: such a row gets its group's smallest id, null if it has none, and isn't kept. Other columns play no part.
    """
    rows = written(_hashed(docs, id_column, text, shingle, halves, width, seed), "minhashes")
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("head")
    nodes = rows.filter("n > 0").groupBy("digest").agg(head, F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    release(docs.sparkSession)
    state = written(buckets(nodes, halves), "buckets")
    release(docs.sparkSession)
    members = written(state.select("node").distinct(), "members")
    sets = written(_sets(docs, nodes.select("node", "head").join(members, "node"), id_column, text, shingle), "sets")
    release(docs.sparkSession)
    search = _Search(nodes.join(members, "node"), sets, least)
    labels, left, open_pairs = rounds(state, search.likely, search.links, search.focused)
    if open_pairs:
        labels, _ = merged(labels, written(search.rest(left, state.select("key", "half").distinct()), "links"))
    named = nodes.join(labels, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.col("head.id").alias("id"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of = named.join(smallest, "root").select("digest", "component_id")
    found = rows.select("id", "n", "digest").join(of, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(_col(id_column) == F.col("component_id"), F.lit(False)))


def minhash_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the smallest id of each group, and all rows without an id; of rows that repeat that id the first by SHA-256 of the text."""
    order, = free_names(docs, "_order")
    kept, = free_names(docs, "_kept_id")
    groups = minhash_groups(docs, id_column, text, **options).filter("kept").select(_col(id_column).alias(kept)).distinct()
    whole = docs.join(groups, _col(id_column).cast("long") == F.col(kept), "left").filter(F.col(kept).isNotNull() | _col(id_column).isNull())
    turn = F.row_number().over(Window.partitionBy(kept).orderBy(F.sha2(F.coalesce(_col(text), F.lit("")).cast("binary"), 256)))
    with_id = whole.filter(F.col(kept).isNotNull()).withColumn(order, turn).filter(F.col(order) == 1).drop(order, kept)
    return with_id.unionByName(whole.filter(F.col(kept).isNull()).drop(kept))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words
), nodes AS (
  SELECT min(doc_id) AS node, s, len(s)::BIGINT AS n FROM sets WHERE len(s) > 0 GROUP BY s
), each AS (SELECT node, n, unnest(s) AS x FROM nodes
), links AS (
  SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), roots AS (SELECT a AS node, min(b) AS root FROM reached GROUP BY a)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets s LEFT JOIN nodes USING (s) LEFT JOIN roots USING (node)
"""
