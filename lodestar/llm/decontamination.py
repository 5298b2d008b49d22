"""Benchmark passages in documents, found by CGK embedding and bit-sampling LSH.

Both sides are read as words. A window of a document as long as a benchmark item is walked by
a random function that moves on or stays by a hash of the current word (Chakraborty, Goldenberg
and Koucky): texts at a small edit distance give strings at a small Hamming distance.
Some positions of the embedded string, sampled anew in each repetition, make an LSH
key. Windows and items that share a key are candidates, and an exact edit distance to the best
part of the window's surroundings decides.

Windows are walked only where they can match: every word pair of an item puts the item's beginning
at a place of the document, and as k edits change at most 2 k of the pairs and move the rest to at most
k + 1 places, one place has enough of them in every passage. Windows that overlap leave a task
as one region with all their keys.

Characters of scripts written without blanks are words of their own. Items too short for keys are sought
as they are: runs of a document's words that hash like an item are joined to it by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import slices, written

#: Random walks, keys sampled from each walk, and positions of a key; chosen so that items with the
#: largest number of edits share a key in over nine of ten cases (tests measure it).
WALKS, KEYS, SAMPLED = 8, 4, 3
REPEATS = WALKS * KEYS
#: Bits of the map of benchmark keys that goes to every task, whatever the benchmark's size.
MAP_BITS = 23
#: Words of the benchmark items that are sought at once; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000
#: Words of the shortest item that is sought with edits, and of the shortest that is sought at all, then word for word.
SHORTEST, LEAST = 8, 4

#: Bytes of words: digits, letters a-z and all of multi-byte characters but the signs below.
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[0x80:] = True

#: First and last characters of scripts without blanks between words: Thai to Burmese, Khmer, radicals, kana and bopomofo, ideographs, half-width kana.
_APART = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
#: Signs among wide characters: vertical and small forms, full-width and half-width signs, the middle dot and double hyphen of kana.
_WIDE_SIGNS = ((0x30A0, 0x30A0), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFEF))


def _among(codes: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.searchsorted([a for a, _ in ranges], codes, side="right") > np.searchsorted([b for _, b in ranges], codes)


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets (rows + 1), first and last byte of each word, and the bytes of all lower-cased texts.

    Signs are all ASCII characters but letters and digits, U+0080 to U+00BF, the general
    punctuation U+2000 to U+207F and the CJK signs U+3000 to U+303F; words lie between them.
    """
    return _spans(texts, False)


def unit_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``word_spans``, but each character of scripts without blanks is a word, and wide signs are signs."""
    return _spans(texts, True)


def _spans(texts: pa.Array, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0] if len(texts) else np.zeros(1, np.int64)
    word = _WORD[data]
    for first, second, length in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(data == first)
        if second is not None and len(at):
            at = at[np.isin(data[at + 1], second)]
        for k in range(length):
            word[at + k] = False
    alone, length = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if apart and len(at := np.flatnonzero(data >= 0xE0)):
        length = np.where(data[at] >= 0xF0, 4, 3)
        codes = data[at].astype(np.int64) & np.where(length == 4, 0x07, 0x0F)
        for k in (1, 2, 3):
            codes = np.where(k < length, codes << 6 | data[np.minimum(at + k, len(data) - 1)] & 0x3F, codes)
        signs = _among(codes, _WIDE_SIGNS)
        for k in range(4):
            word[at[signs & (k < length)] + k] = False
        chosen = _among(codes, _APART) & ~signs
        alone, length = at[chosen], length[chosen]
    inner = ends[1:-1][ends[1:-1] < len(data)]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    opens[inner] = word[inner]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    last = inner[inner > 0] - 1
    closes[last] = word[last]
    if len(alone):
        before, after = alone[alone > 0] - 1, (alone + length)[alone + length < len(data)]
        opens[alone] = closes[alone + length - 1] = True
        opens[after], closes[before] = word[after], word[before]
    starts = np.flatnonzero(opens)
    return np.searchsorted(starts, ends), starts, np.flatnonzero(closes) + 1, data


def hashed(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, at_once: int = 4 << 20) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed."""
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    power = np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        base = total[first] - lengths[first]
        stop = max(first + 1, int(np.searchsorted(total, base + at_once, side="right")))
        mine = lengths[first:stop]
        begin = np.cumsum(mine) - mine
        place = np.arange(int(mine.sum())) - np.repeat(begin, mine)
        values = (data[np.repeat(starts[first:stop], mine) + place].astype(np.uint64) + np.uint64(1)) * power[place]
        out[first:stop] = np.add.reduceat(values, begin)
        first = stop
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def normal_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Words joined by blanks."""
    return " ".join(data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` neighbouring words."""
    out = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def window_length(n: int) -> int:
    """The window length of an item of ``n`` words, on a ladder of steps of a tenth: its first words, over nine tenths."""
    length = SHORTEST
    while (longer := max(length + 1, int(length * 1.1))) <= n:
        length = longer
    return length


def edits(n: int, rate: float) -> int:
    return int(n * rate)


def embedding_keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, seed: int = 42) -> np.ndarray:
    """LSH keys (windows x REPEATS) of windows of at most ``length`` words; behind its end a window reads blanks."""
    out = np.empty((len(starts), REPEATS), dtype=np.uint64)
    padded = np.append(h, np.uint64(0))
    for w in range(WALKS):
        rng = np.random.default_rng([seed, length, w])
        move = rng.integers(0, 1 << 63, 3 * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        chosen = [np.sort(rng.choice(3 * length, SAMPLED, replace=False)) for _ in range(KEYS)]
        takes: dict[int, list[int]] = {}
        for k, places in enumerate(chosen):
            for j in places.tolist():
                takes.setdefault(j, []).append(w * KEYS + k)
        at = starts.copy()
        for k in range(KEYS):
            out[:, w * KEYS + k] = xxhash.xxh64_intdigest(f"{length}/{w}/{k}")
        for j in range(max(takes) + 1):
            word = np.where(at < ends, padded[np.minimum(at, len(h))], np.uint64(0))
            for k in takes.get(j, ()):
                key = (out[:, k] ^ word) * np.uint64(0x9E3779B97F4A7C15)
                out[:, k] = key ^ (key >> np.uint64(29))
            at += ((word * move[j]) >> np.uint64(63)).astype(np.int64)
    return out


def substring_distance(pattern: list, text: list) -> int:
    """Least edit distance of ``pattern`` to a part of ``text``, by bit-parallel columns (Myers)."""
    m = len(pattern)
    if not m:
        return 0
    where: dict = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for x in text:
        eq = where.get(x, 0)
        cross = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = (down | ~(cross | up)) & full, up & cross
        score += 1 if plus & high else -1 if minus & high else 0
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~((eq | down) | plus)) & full, plus & (eq | down)
        best = min(best, score)
    return best


def _items(benchmark: DataFrame, id_column: str, text: str, least: int) -> DataFrame:
    """Normalised items of ``least`` words or more: ``item``, ``norm``, ``n``."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            offsets, starts, ends, data = unit_spans(batch.column(text))
            joined = [normal_text(data, starts[i:j], ends[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(joined, pa.string()), pa.array(np.diff(offsets))], names=["item", "norm", "n"])

    kind = benchmark.schema[id_column].dataType.simpleString()
    rows = benchmark.select(id_column, text).mapInArrow(normal, f"item {kind}, norm string, n long")
    return written(rows.filter(F.col("n") >= max(1, least)), "items")


def _item_keys(items: DataFrame) -> DataFrame:
    """``norm``, its LSH ``keys``, window ``length`` and the hashes of its word pairs, of each distinct item."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"norm": [], "n": [], "length": [], "keys": [], "pairs": []}
            for norm in batch.column("norm").to_pylist():
                _, starts, ends, data = unit_spans(pa.array([norm]))
                h = hashed(starts, ends, data)
                length = window_length(len(h))
                out["norm"].append(norm)
                out["n"].append(len(h))
                out["length"].append(length)
                out["keys"].append(embedding_keys(h, np.zeros(1, np.int64), np.full(1, length), length)[0].view(np.int64).tolist())
                out["pairs"].append(pairs(h).view(np.int64).tolist())
            whole, many = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("norm", pa.string()), ("n", whole), ("length", whole), ("keys", many), ("pairs", many)]))

    return items.select("norm").distinct().mapInArrow(keyed, "norm string, n long, length long, keys array<long>, pairs array<long>")


class _Beginnings:
    """Where a word pair puts beginnings of items: offsets by window length, for each pair of the benchmark."""

    def __init__(self, entries: np.ndarray, longest: dict[int, int], rate: float):
        order = np.argsort(entries[:, 0].view(np.uint64), kind="stable")
        self.hashes, self.length, self.back = entries[order, 0].view(np.uint64), entries[order, 1], entries[order, 2]
        self.known = np.unique(self.hashes)
        self.first = np.searchsorted(self.hashes, self.known)
        self.count = np.diff(np.append(self.first, len(self.hashes)))
        self.longest, self.rate = longest, rate

    def windows(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each length, first and last word of the windows that can match."""
        p = pairs(h)
        at = np.minimum(np.searchsorted(self.known, p), len(self.known) - 1)
        hit = self.known[at] == p
        before = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        where = np.flatnonzero(hit)
        row = np.searchsorted(offsets, where, side="right") - 1
        where, row, at = where[where + 1 < offsets[row + 1]], row[where + 1 < offsets[row + 1]], at[where[where + 1 < offsets[row + 1]]]
        most = max(1, (4 << 20) // max(1, int(self.count.max())))
        parts = []
        for i in range(0, len(where), most):
            n = self.count[at[i : i + most]]
            entry = np.repeat(self.first[at[i : i + most]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            start = np.maximum(np.repeat(where[i : i + most], n) - self.back[entry], offsets[np.repeat(row[i : i + most], n)])
            parts.append(np.unique((self.length[entry] << 40) + start, return_counts=True))
        if not parts:
            return
        codes, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        votes = np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        for length, longest in self.longest.items():
            k = edits(longest, self.rate)
            i, j = np.searchsorted(codes, [length << 40, (length + 1) << 40])
            a = (codes[i:j] & ((1 << 40) - 1))[votes[i:j] * (k + 1) >= length - 1 - 2 * k]
            b = np.minimum(a + length, offsets[np.searchsorted(offsets, a, side="right")])
            fits = (b - a >= max(2, length - k)) & (before[b - 1] - before[a] >= length - 1 - 2 * k)
            yield length, a[fits], b[fits]


def regions(first: np.ndarray, last: np.ndarray, most: int = 1024) -> Iterator[np.ndarray]:
    """Runs of spans, given in the order of ``first``, that overlap and begin within ``most`` words: each run's numbers."""
    at = 0
    while at < len(first):
        reach = np.maximum.accumulate(last[at : at + 4 * most])
        stop = min(int(np.searchsorted(first, first[at] + most, side="right")), at + len(reach))
        apart = np.flatnonzero(first[at + 1 : stop] >= reach[: stop - at - 1])
        stop = at + 1 + int(apart[0]) if len(apart) else stop
        yield np.arange(at, stop)
        at = stop


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """A map of 2^MAP_BITS bits with one for each hash in the only column of ``hashes``."""
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - MAP_BITS)
    parts = hashes.select(place.alias("p")).selectExpr("shiftright(p, 6) AS at", "shiftleft(1L, int(p & 63)) AS bits")
    rows = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """Pairs of documents and benchmark items that they hold: id, item id, ``distance`` (in words) and ``n_words`` of the item.

    A document holds an item if some part of it is at most ``rate`` times the item's words away, by
    insertions, deletions and substitutions of words; case and signs don't count, and each character
    of scripts without blanks is a word. Items of fewer than eight words are held only without
    edits. Items of fewer than ``least`` words are phrases of any text and match nothing; null and blank texts neither.
    Equal items are sought once and all reported. Documents of one id count as one.
    Only windows with a benchmark's key leave a task: their keys and words, not the texts. The
    pairs of BLOCK_WORDS words of the benchmark go to every task; a larger benchmark is
    sought block by block.
    """
    items = _items(benchmark, item_column, item_text, least)
    indexed = written(_item_keys(items.filter(F.col("n") >= SHORTEST)), "item-keys")
    blocks = -(-(indexed.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS)
    block = F.pmod(F.xxhash64("norm"), F.lit(max(1, blocks)))
    sure = [_block_matches(docs, indexed.filter(block == k), rate, id_column, text) for k in range(max(1, blocks))]
    sure += _exact_matches(docs, items.filter(F.col("n") < SHORTEST).select("norm", "n").distinct(), id_column, text)
    best = reduce(DataFrame.unionByName, sure).groupBy(id_column, "norm").agg(F.min("distance").alias("distance"))
    return best.join(items, "norm").select(id_column, F.col("item").alias(item_column), "distance", F.col("n").alias("n_words"))


def _block_matches(docs: DataFrame, indexed: DataFrame, rate: float, id_column: str, text: str) -> DataFrame:
    """``id_column``, ``norm`` and ``distance`` of matches of some items."""
    longest = {r.length: r.n for r in indexed.groupBy("length").agg(F.max("n").alias("n")).collect()}
    entries = indexed.select("length", F.posexplode("pairs").alias("back", "h")).select("h", "length", F.col("back").cast("long")).toPandas().to_numpy(dtype=np.int64)
    key_map = _bit_map(indexed.select(F.explode("keys").alias("h")))
    beginnings = _Beginnings(entries, longest, rate) if len(entries) else None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            offsets, starts, ends, data = unit_spans(batch.column(text))
            if len(starts) < 2 or beginnings is None:
                continue
            h = hashed(starts, ends, data)
            rows: dict[str, list] = {id_column: [], "keys": [], "around": []}
            spans, found = [], []
            for length, first, stop in beginnings.windows(h, offsets):
                keys = embedding_keys(h, first, stop, length)
                hit = _in_map(key_map, keys)
                near, wide = np.flatnonzero(hit.any(axis=1)), edits(longest[length], rate)
                r = np.searchsorted(offsets, first[near], side="right") - 1
                a = np.maximum(offsets[r], first[near] - wide)
                spans.append(np.stack([a, np.minimum(offsets[r + 1], first[near] + longest[length] + wide), r], axis=1))
                found += [keys[i][hit[i]] for i in near.tolist()]
            span = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
            order = np.lexsort((span[:, 1], span[:, 0]))
            for run in regions(span[order, 0], span[order, 1]):
                mine = order[run]
                a, b = int(span[mine, 0].min()), int(span[mine, 1].max())
                rows[id_column].append(batch.column(id_column)[int(span[mine[0], 2])].as_py())
                rows["keys"].append(np.unique(np.concatenate([found[i] for i in mine])).view(np.int64).tolist())
                rows["around"].append(normal_text(data, starts[a:b], ends[a:b]))
            schema = pa.schema([(id_column, batch.column(id_column).type), ("keys", pa.list_(pa.int64())), ("around", pa.string())])
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    id_kind = docs.schema[id_column].dataType.simpleString()
    seen = docs.select(id_column, text).mapInArrow(windows, f"{id_column} {id_kind}, keys array<long>, around string")
    probes = seen.select(id_column, "around", F.explode("keys").alias("key"))
    index = indexed.select("norm", F.explode("keys").alias("key"))
    # passages are common to many documents: each is verified once
    around = written(probes.distinct(), "passages")
    candidates = around.select("around", "key").distinct().join(index, "key").select("around", "norm").distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, texts = batch.column("norm").to_pylist(), batch.column("around").to_pylist()
            split = [n.split(" ") for n in norms]
            far = np.array([substring_distance(p, t.split(" ")) for p, t in zip(split, texts, strict=True)], dtype=np.int64)
            near = far <= np.array([edits(len(p), rate) for p in split], dtype=np.int64)
            out = [batch.column("around"), batch.column("norm"), pa.array(far)]
            yield pa.RecordBatch.from_arrays(out, names=["around", "norm", "distance"]).filter(pa.array(near))

    sure = candidates.mapInArrow(verified, "around string, norm string, distance long")
    best = written(sure, "verified")
    return around.select(id_column, "around").distinct().join(best, "around").select(id_column, "norm", "distance")


def _exact_matches(docs: DataFrame, short: DataFrame, id_column: str, text: str) -> list[DataFrame]:
    """``id_column``, ``norm`` and ``distance`` 0 of runs of words that hash like a short item, block by block; the join on ``norm`` decides."""
    blocks = -(-(short.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS)
    block = F.pmod(F.xxhash64("norm"), F.lit(max(1, blocks)))
    id_kind = docs.schema[id_column].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, starts, ends, data = unit_spans(batch.column("norm"))
            h = hashed(starts, ends, data)
            keys = [run_hashes(h[i:j], j - i)[0] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64())], names=["n", "h"])

    def finder(rows: np.ndarray):
        known = {n: np.unique(rows[rows[:, 0] == n, 1].view(np.uint64)) for n in np.unique(rows[:, 0]).tolist()}

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                offsets, starts, ends, data = unit_spans(batch.column(text))
                h = hashed(starts, ends, data)
                for n, keys in known.items():
                    runs = run_hashes(h, n)
                    at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs)
                    row = np.searchsorted(offsets, at, side="right") - 1
                    at, row = at[at + n <= offsets[row + 1]], row[at + n <= offsets[row + 1]]
                    _, once = np.unique(np.stack([row.astype(np.uint64), runs[at]], axis=1), axis=0, return_index=True)
                    norms = [normal_text(data, starts[i : i + n], ends[i : i + n]) for i in at[once].tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(row[once])), pa.array(norms, pa.string()), pa.array(np.zeros(len(once), np.int64))], names=[id_column, "norm", "distance"])

        return found

    out = []
    for k in range(blocks):
        rows = short.filter(block == k).mapInArrow(keyed, "n long, h long").toPandas().to_numpy(dtype=np.int64)
        if len(rows):
            out.append(docs.select(id_column, text).mapInArrow(finder(rows), f"{id_column} {id_kind}, norm string, distance long"))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, id_column: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without those that hold a benchmark item. Rows without an id are matched as one document: all go or stay."""
    matched = benchmark_matches(docs, benchmark, rate, id_column, text, least=least).select(F.col(id_column).alias("_hit")).distinct()
    return docs.join(matched, docs[id_column].eqNullSafe(matched["_hit"]), "left_anti")
