"""SimHash fingerprints of word shingles, their groups at a small Hamming distance, and near-duplicate removal.

Links between distinct fingerprints are found exactly. Two that differ in at most ``radius`` bits
agree in whole blocks of bits, so each fingerprint is dealt to one bucket for every choice of
some blocks. Inside a bucket a table of Hamming distances to reference fingerprints (pivots)
makes the candidates: rows are sorted by their first coordinate and compared only as far as it differs
by ``radius`` at most; pairs whose largest coordinate difference is over that are discarded by the
triangle inequality, and an XOR verifies the survivors. A bucket sends out a spanning forest of its
links, never all of its pairs.

Fingerprints within 4 bits miss most texts of a similarity of 0.8. For removal several
fingerprints of word pairs are made of each text, with independent hashes; texts that are close in one of
them are candidates, and whole sets of five-word shingles verify them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import free_names, row_hash, slices, words, written
from lodestar.llm.components import connected_components
from lodestar.llm.rounds import merged, outside_links, rounds

BITS = 64
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 17
#: Fingerprints of word pairs that the removal makes of a text. A pair of texts that share 0.8 of their
#: five-word shingles is within 4 bits in one of them in over nine of ten cases (tests measure it).
PRINTS = 10
#: Bytes of shingles of a component that one task compares by itself.
BLOCK_BYTES = 2 << 20

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Each byte's bits as eight counters in one word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).view(np.uint64).ravel()


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _lane(x: np.ndarray) -> np.ndarray:
    return _turned(x * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many parts of ``data``; parts of one length are hashed together, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    fours = np.ndarray((len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))
    out, by = np.empty(len(starts), np.uint64), np.uint64(seed)
    # sixteen bits are sorted in linear time
    order = np.argsort(lengths.astype(np.uint16) if lengths.max() < 1 << 16 else lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    with np.errstate(over="ignore"):
        for some in np.split(order, cuts):
            n, at = int(lengths[some[0]]), starts[some]
            end = at + n
            if n >= 32:
                lanes = [np.full(len(at), x) for x in (by + _P1 + _P2, by + _P2, by, by - _P1)]
                for _ in range(n // 32):
                    lanes = [_turned(x + eights[at + 8 * k] * _P2, 31) * _P1 for k, x in enumerate(lanes)]
                    at = at + 32
                h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
                for x in lanes:
                    h = (h ^ _lane(x)) * _P1 + _P4
            else:
                h = np.full(len(at), by + _P5)
            h = h + np.uint64(n)
            for _ in range(n % 32 // 8):
                h = _turned(h ^ _lane(eights[at]), 27) * _P1 + _P4
                at = at + 8
            if n % 8 >= 4:
                h = _turned(h ^ fours[at].astype(np.uint64) * _P1, 23) * _P2 + _P3
            for k in range(n % 4, 0, -1):
                h = _turned(h ^ data[end - k].astype(np.uint64) * _P5, 11) * _P1
            h = (h ^ h >> np.uint64(33)) * _P2
            h = (h ^ h >> np.uint64(29)) * _P3
            out[some] = h ^ h >> np.uint64(32)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection whose every bit depends on all."""
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _prints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each row, which has the next ``counts`` of the hashes, the bits that over half of them have; 0 without any."""
    rows = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if not len(rows):
        return out
    # runs of at most 255 hashes of a row, so that the eight counters of a word don't overflow
    runs = -(-counts[rows] // 255)
    first_run = np.cumsum(runs) - runs
    first = np.cumsum(counts[rows]) - counts[rows]
    starts = np.repeat(first, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first_run, runs))
    ends = np.append(starts[1:], len(hashes))
    sums, at = np.empty((len(starts), BITS), np.uint8), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + COUNTED, side="right")))
        part = hashes[starts[at] : ends[stop - 1]].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums[at:stop] = np.add.reduceat(_SPREAD[part], starts[at:stop] - starts[at], axis=0).view(np.uint8)
        at = stop
    total = np.add.reduceat(sums, first_run, axis=0, dtype=np.int64)
    out[rows] = np.packbits(2 * total > counts[rows][:, None], axis=1).view(">u8").ravel()
    return out


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, first byte and end of each lower-cased word, and the bytes of all words, each with a blank behind it."""
    offsets, flat = words(pc.ascii_lower(texts))
    joined = pc.binary_join_element_wise(flat.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(joined) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    return offsets, ends[:-1], ends[1:] - 1, data


def _shingles(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and their number by row; a row of fewer words is one shingle."""
    n = np.diff(offsets)
    row_end = np.repeat(offsets[1:], n)
    first = np.arange(offsets[-1])
    first = first[(first + size <= row_end) | (first == np.repeat(offsets[:-1], n))]
    return first, np.minimum(first + size, row_end[first]) - 1, np.where(n > 0, np.maximum(n - size + 1, 1), 0)


def text_prints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned SimHash of each text."""
    offsets, starts, ends, data = _spaced(texts)
    first, last, counts = _shingles(offsets, shingle)
    return _prints(xxh64(data, starts[first], ends[last] - starts[first], seed), counts)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, starts, ends, data = _spaced(texts)
    return offsets, xxh64(data, starts, ends - starts)


def _run_hashes(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles from those of their words, and their number by row."""
    first, last, counts = _shingles(offsets, size)
    out = (last - first).astype(np.uint64)
    for k in range(size):
        inside = first + k <= last
        out = _mixed(out * _P1 + np.where(inside, h[np.minimum(first + k, last)], np.uint64(k)))
    return out, counts


def distinct_hashes(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, one after the other, and their numbers; ``found`` is sorted in place."""
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        found[a:b].sort()
    new = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
    new[(ends - counts)[counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return found[new], kept[ends] - kept[ends - counts]


def pair_prints(texts: pa.Array, n: int = PRINTS, seed: int = 42) -> np.ndarray:
    """``n`` SimHashes of the distinct word pairs of each text, by independent hashes (rows x n): what a text repeats has one vote."""
    offsets, h = _word_hashes(texts)
    pairs, counts = distinct_hashes(*_run_hashes(h, offsets, 2))
    keys = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _P4 + np.uint64(seed))
    return np.stack([_prints(_mixed(pairs ^ key), counts) for key in keys], axis=1) if len(texts) else np.zeros((0, n), np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """Adds the SimHash of each text as a signed long ``name``. Map-only.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; every occurrence of a shingle
    votes. A text of fewer words is one shingle; null, empty and blank texts get 0.
    """
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            prints = text_prints(batch.column(text), shingle, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, name])

    return kept.mapInArrow(hashed, schema)


def pivots(n: int, seed: int = 42) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed) for i in range(n)], dtype=np.uint64)


def _blocks(n: int) -> list[tuple[int, int]]:
    """First bit and width of ``n`` blocks that cover all bits evenly."""
    edges = [i * BITS // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shared_blocks(rows: int, radius: int, most: int = 128) -> int:
    """How many equal blocks make a bucket: at least two, more as the table grows, so that by chance a bucket holds ``most`` at most."""
    shared = 2
    while rows >> (shared * BITS // (radius + shared)) > most and comb(radius + shared, shared) < 200:
        shared += 1
    return shared


def _keys(fp: Column, radius: int, shared: int) -> Column:
    """The buckets of a fingerprint: for every choice of ``shared`` of ``radius + shared`` blocks its number and the bits."""
    blocks = _blocks(radius + shared)
    cut = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in blocks]

    def bits(some: tuple[int, ...]) -> Column:
        out = cut[some[0]]
        for i in some[1:]:
            out = F.shiftleft(out, blocks[i][1]).bitwiseOR(cut[i])
        return out

    return F.array(*[F.struct(F.lit(k).alias("choice"), bits(some).alias("bits")) for k, some in enumerate(combinations(range(len(cut)), shared))])


class _Joined:
    """Labels of rows that grow together."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def top(self, x: int) -> int:
        while self.label[x] != x:
            x = self.label[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.label[max(x, y)] = min(x, y)
        return x != y

    def flatten(self) -> None:
        while (up := self.label[self.label] != self.label).any():
            self.label[up] = self.label[self.label[up]]


def _together(run: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each row the first row of its run that has its id."""
    out, order = np.arange(len(run)), np.lexsort((ids, run))
    new = np.flatnonzero(np.append(True, (np.diff(run[order]) != 0) | (np.diff(ids[order]) != 0)))
    out[order] = np.repeat(order[new], np.diff(np.append(new, len(run))))
    return out


def _forest(run: np.ndarray, fp: np.ndarray, radius: int, refs: np.ndarray, tally: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal values of ``run``; rows of equal ``ids`` are joined from the start.

    Rows of a run are sorted by their distance to the first pivot, and every row is compared with the
    row ``step`` places on, for growing steps, until that coordinate differs by more than the
    radius: it does so for all further ones. ``tally`` counts pairs seen, left by the pivots, and linked.
    """
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((fp, table[:, 0], run))
    run, fp, table = run[order], fp[order], table[order]
    joined = _Joined(n)
    if ids is not None and n:
        joined.label = _together(run, ids[order])
    out_a, out_b = [], []
    left = np.arange(n)
    for step in range(1, n):
        left = left[left + step < n]
        left = left[run[left] == run[left + step]]
        left = left[table[left + step, 0] - table[left, 0] <= radius]
        if not len(left):
            break
        i = left[joined.label[left] != joined.label[left + step]]
        seen = len(i)
        for k in range(1, len(refs)):
            i = i[np.abs(table[i, k] - table[i + step, k]) <= radius]
        near = len(i)
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        if tally is not None:
            tally += seen, near, len(i)
        if not len(i):
            continue
        for a in i.tolist():
            if joined.join(a, a + step):
                out_a.append(a)
                out_b.append(a + step)
        joined.flatten()
    return order[np.array(out_a, dtype=np.int64)], order[np.array(out_b, dtype=np.int64)]


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Sorted rows in whole runs of equal ``columns``, with each row's run; the last run of a batch waits for the next one.

    A run that grows beyond ``most`` rows while it waits isn't gathered: its first row comes alone, without a number.
    """
    held: list[pa.RecordBatch] = []
    over = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if over:  # the rest of a long run goes by
            part = pa.Table.from_batches([*held, batch])
            cuts = np.flatnonzero(_changes(part, columns)) + 1
            if not len(cuts):
                continue
            over, held = False, []
            batch = batch.slice(int(cuts[0]) - 1)
        held.append(batch)
        part = pa.Table.from_batches(held)
        cuts = np.flatnonzero(_changes(part, columns)) + 1
        if len(cuts):
            yield _numbered(part.slice(0, int(cuts[-1])), columns)
            part = part.slice(int(cuts[-1])).combine_chunks()
            held = part.to_batches()
        if most is not None and part.num_rows > most:
            held, over = part.slice(0, 1).combine_chunks().to_batches(), True
            yield pa.Table.from_batches(held), None
    if held and not over:
        yield _numbered(pa.Table.from_batches(held), columns)


def _numbered(part: pa.Table, columns: list[str]) -> tuple[pa.Table, np.ndarray]:
    return part, np.concatenate([[0], np.cumsum(_changes(part, columns))])


def _changes(part: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the row before it, from the second row on."""
    out = np.zeros(max(0, part.num_rows - 1), dtype=bool)
    for name in columns:
        values = part.column(name).to_numpy()
        out |= values[1:] != values[:-1]
    return out


def _dealt(rows: DataFrame, blocks: Column, by: str) -> DataFrame:
    """Rows of a large bucket in every pair of its ``blocks`` that their own block, by a hash of ``by``, is in: ``low`` and ``high``."""
    dealt = rows.withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "own", "other")


def links(prints: DataFrame, radius: int = 4, n_pivots: int = 16, bucket_rows: int = 2048, shared: int | None = None) -> DataFrame:
    """Edges ``a, b`` between ids whose fingerprints differ in at most ``radius`` bits.

    ``prints`` has one row (id long, fp long) per distinct fingerprint, or (no int, id, fp) per
    distinct fingerprint of each of several kinds, which are compared apart. Rows of one id are one node, so links
    inside a group that is known already are neither sought nor sent. The edges are a
    subset of all links with the same connected components. Ids and fingerprints are dealt to the buckets, once; a bucket of
    more than ``bucket_rows`` of them is set aside, dealt again in blocks, and each pair of blocks is a task of its
    own: memory stays bounded, and no pair is left out. ``shared`` blocks of bits are equal in a bucket; by
    default their number follows from the size of the table, and the links don't depend on it.
    """
    if "no" not in prints.columns:
        prints = prints.withColumn("no", F.lit(0))
    if shared is None:
        shared = shared_blocks(prints.groupBy("no").count().agg(F.max("count")).first()[0] or 0, radius)
    refs, bucket = pivots(n_pivots), ["kind", "bits"]
    n_choices = comb(radius + shared, shared)
    keyed = prints.withColumn("k", F.explode(_keys(F.col("fp"), radius, shared))).select((F.col("no") * n_choices + F.col("k.choice")).alias("kind"), "k.bits", "id", "fp")
    edge = "kind int, bits long, a long, b long"

    def forest(part: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        ids = part.column("id").to_numpy()
        a, b = _forest(run, part.column("fp").to_numpy().view(np.uint64), radius, refs, ids=ids)
        kinds = part.column("kind").to_numpy()[a]
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.nulls(len(a), pa.int64()), pa.array(ids[a]), pa.array(ids[b])], names=["kind", "bits", "a", "b"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, run in _runs(batches, bucket, bucket_rows):
            if run is not None:
                # most buckets hold one fingerprint; a bucket that came whole in one batch may still be long
                sizes = np.bincount(run)
                fits = (sizes[run] > 1) & (sizes[run] <= bucket_rows)
                if fits.any():
                    yield forest(part.filter(pa.array(fits)), run[fits])
                part = part.take(pa.array(np.flatnonzero(np.diff(run, prepend=-1) & (sizes[run] > bucket_rows))))
            if part.num_rows:
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("kind").combine_chunks(), part.column("bits").combine_chunks(), none, none], names=["kind", "bits", "a", "b"])

    cell = [*bucket, "low", "high"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, run in _runs(batches, cell):
            yield forest(part, run)

    first = written(keyed.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(searched, edge), "bucket-links")
    large = first.filter("a IS NULL").select(*bucket).distinct()
    rest = keyed.join(large, bucket)
    sizes = rest.groupBy(*bucket).agg(F.count("*").alias("n"))
    dealt = _dealt(rest.join(sizes, bucket), F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int"), "fp").drop("n")
    second = dealt.repartition(*cell).sortWithinPartitions(*cell, "fp").mapInArrow(compared, edge)
    found = first.filter("a IS NOT NULL")
    if not large.isEmpty():
        found = found.unionByName(second)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Of each row: its id (a whole number), ``fp`` and ``component_id``, the smallest id reachable over links.

    Rows with equal fingerprints are one node, so groups of copies cost nothing more. Repeated
    rows stay. A row whose id is null gets the component of its fingerprint, if any id has
    that, else null. Only ids and fingerprints are shuffled, never texts.
    """
    prints = written(fingerprints(docs.select(id_column, text), text, shingle, seed).select(id_column, "fp"), "fingerprints")
    nodes = written(prints.filter(F.col(id_column).isNotNull()).groupBy("fp").agg(F.min(F.col(id_column).cast("long")).alias("id")), "nodes")
    roots = connected_components(links(nodes, radius)).select(F.col("node").alias("id"), "root")
    named = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select(id_column, "fp", "component_id")


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least that share of their union in common; empty sets are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    whole = len(a) + len(b)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (whole - common)


def _verified(run: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each text to the first text of its group, for the texts of each run that are close in a fingerprint and similar by their sets."""
    n, sizes = len(run), np.array([len(s) for s in sets])
    joined = _Joined(n)
    left = np.arange(n)
    for step in range(1, n):
        left = left[left + step < n]
        left = left[run[left] == run[left + step]]
        if not len(left):
            break
        i = left[joined.label[left] != joined.label[left + step]]
        small, large = np.minimum(sizes[i], sizes[i + step]), np.maximum(sizes[i], sizes[i + step])
        i = i[small >= least * large]
        i = i[(np.bitwise_count(prints[i] ^ prints[i + step]) <= radius).any(axis=1)]
        for a in i.tolist():
            if joined.top(a) != joined.top(a + step) and _similar(sets[a], sets[a + step], least):
                joined.join(a, a + step)
        if len(i):
            joined.flatten()
    tied = np.flatnonzero(joined.label != np.arange(n))
    return tied, joined.label[tied]


def _large_groups(sets: DataFrame, names: list[str], radius: int, least: float) -> DataFrame:
    """Edges of the groups in large components; ``sets`` has ``root`` (the component), ``node``, fingerprints and ``shingles``.

    Texts are compared with centres of their component, round by round. What is then left are texts outside of the largest group of
    their component: these are compared with all others of it, in blocks.
    """
    prints = written(sets.select("root", "node", F.size("shingles").alias("n"), F.array(*names).alias("prints")), "large-prints")
    short = prints.select("node", "n", "prints")

    def closest(pairs: DataFrame) -> DataFrame:
        a = short.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("prints").alias("ap"))
        b = short.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("prints").alias("bp"))
        close = F.exists(F.zip_with("ap", "bp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), lambda d: d <= radius)
        return pairs.join(a, "a").join(b, "b").filter((F.least("an", "bn") >= least * F.greatest("an", "bn")) & close).select("a", "b")

    def links(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.filter(F.col("common") >= least * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")

    labels, left, open_pairs = rounds(prints.select(F.col("root").alias("key"), "node"), closest, links)
    if open_pairs:
        rows = left.join(sets.select("node", F.array(*names).alias("prints"), "shingles"), "node")
        found = outside_links(rows, lambda common, n, own: common >= least * (n + own - common), lambda a, b: (np.bitwise_count(a ^ b) <= radius).any(axis=1))
        labels, _ = merged(labels, written(found, "links"))
    return labels.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 4, least: float = 0.8, shingle: int = 5, n_prints: int = PRINTS, seed: int = 42, bucket_rows: int = 2048, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each distinct text: its SHA-256 ``digest``, the ``least`` id that has it, and ``root``, equal in a group of near duplicates.

    Two texts are linked if one of their ``n_prints`` fingerprints of word pairs differs in at most
    ``radius`` bits and their sets of ``shingle`` words share at least ``least`` of their union; groups are the
    components of all links. First the fingerprints alone give candidate components: those of the first
    fingerprint are one node each while the others are searched, so a large group sends its links once and not from
    every bucket of every fingerprint. Only texts in a component of two or more are read again, as sorted hashes of their shingles, and compared inside it. In a component of more than
    ``block_bytes`` of hashes texts are compared with centres, round by round, and the few that are left by their fingerprints with all others.
    Null and blank texts have no shingles and equal each other. Ids are whole numbers or null.
    """
    names = [f"p{k}" for k in range(n_prints)]
    body = docs.select(_digest(text).alias("digest"), F.col(id_column).cast("long").alias("least"), F.col(text).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pair_prints(batch.column("text"), n_prints, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(found[:, k]) for k in range(n_prints)]], names=["digest", "least", *names])

    rows = body.mapInArrow(printed, "digest binary, least long, " + ", ".join(f"{x} long" for x in names))
    # copies are one node: their fingerprints are equal, so any will do
    nodes = rows.groupBy("digest").agg(F.min("least").alias("least"), *[F.max(x).alias(x) for x in names])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    kinds = F.array(*[F.struct(F.lit(k).alias("no"), F.col(x).alias("fp")) for k, x in enumerate(names)])
    each = nodes.select("node", F.explode(kinds).alias("k")).select("k.no", "k.fp", "node")

    def searched(some: DataFrame, name: str) -> DataFrame:
        first = written(some.groupBy("no", "fp").agg(F.min("node").alias("id"), F.max("node").alias("last")), name)
        # nodes with an equal fingerprint are tied to the first of them, and only that one is searched
        equal = some.join(first.filter("id <> last"), ["no", "fp"]).filter("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
        return links(first.select("no", "id", "fp"), radius, bucket_rows=bucket_rows).unionByName(equal.distinct())

    known = written(connected_components(searched(each.filter("no = 0"), "prints")), "known")
    joined = each.filter("no > 0").join(known, "node", "left").select("no", "fp", F.coalesce("root", "node").alias("node"))
    more = searched(joined, "more-prints")
    roots = written(connected_components(more.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))), "candidates")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, h = _word_hashes(batch.column("text"))
            found, counts = _run_hashes(h, offsets, shingle)
            flat, counts = distinct_hashes(found, counts)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "shingles"])

    members = written(nodes.join(roots, "node").select("digest", "least", "node", "root", *names), "members")
    once = body.join(members, (body["digest"] == members["digest"]) & body["least"].eqNullSafe(members["least"])).select("root", "node", *names, "text").dropDuplicates(["node"])
    kinds_ddl = ", ".join(f"{x} long" for x in names)
    sets = written(once.mapInArrow(shingled, f"root long, node long, {kinds_ddl}, shingles array<long>"), "shingles")
    sizes = written(sets.groupBy("root").agg(F.sum(8 * F.size("shingles") + F.lit(64 + 8 * n_prints)).alias("n")), "sizes")
    large = sizes.filter(F.col("n") > block_bytes).select("root")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, run in _runs(batches, ["root"]):
            ids = part.column("node").to_numpy()
            prints = np.stack([part.column(x).to_numpy().view(np.uint64) for x in names], axis=1)
            lists = part.column("shingles").combine_chunks()
            found = np.split(lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
            a, b = _verified(run, prints, found, radius, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])

    small = sets.join(large, "root", "left_anti")
    sure = small.repartition("root").sortWithinPartitions("root", "node").mapInArrow(compared, "a long, b long")
    if not large.isEmpty():
        sure = sure.unionByName(_large_groups(written(sets.join(large, "root"), "large"), names, radius, least))
    groups = connected_components(sure).select("node", F.col("root").alias("_root"))
    return nodes.join(groups, "node", "left").select("digest", "least", F.coalesce("_root", "node").alias("root"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 4, least: float = 0.8, shingle: int = 5, n_prints: int = PRINTS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, as ``near_groups`` finds them; columns are those of ``docs``.

    The row with the smallest id stays (null comes last), of rows of that id the one with the smallest SHA-256
    of its text, and of rows equal in both the one that a hash of the whole row picks. Copies are one text from the
    start, and null and blank texts are one group. Ids may repeat: a row goes or stays by its text.
    """
    digest, order, place = free_names(docs, "_text_digest", "_order", "_place")
    groups = near_groups(docs, id_column, text, radius, least, shingle, n_prints)
    first = F.min(F.struct(F.col("least").isNull().alias("n"), "least", "digest"))
    heads = groups.groupBy("root").agg(first.alias("h")).select(F.col("h.digest").alias("_digest"), F.col("h.least").alias("_least"))
    marked = docs.withColumns({digest: _digest(text), order: row_hash(docs)})
    kept = marked.join(heads, (F.col(digest) == F.col("_digest")) & F.col(id_column).cast("long").eqNullSafe(F.col("_least")), "left_semi")
    one = F.row_number().over(Window.partitionBy(digest, id_column).orderBy(order))
    return kept.withColumn(place, one).filter(F.col(place) == 1).drop(digest, order, place)
