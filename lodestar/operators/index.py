"""A search index in a folder: postings of terms with positions, postings of vector places, document frequencies and chunks.

A row of ``postings`` is one term in one block of chunk numbers: gaps of the chunks' numbers, their counts and gaps of positions. A block is
posted by the task that reads its chunks, so a build sends no occurrences: each file of postings is sorted by term, and a query skips its other pages.
Where two tasks read a block it has two rows for a term; their chunks are apart, so rows of different halves have none in common.
A query reads the rows of its terms only, joins them block by block from the rarest term on, and computes
cover density from the positions. ``places`` is the same for hashed embeddings: one place of the vector in one block, with the
chunks' values there. Texts are read for the last few rows alone.

The index lives where it is written. Changed objects are added as a new generation that hides their older chunks;
nothing that exists is rewritten.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.checkpoints import is_file
from lodestar.functions.runs import changes, packed, packed_runs, unpacked, whole_runs
from lodestar.functions.vectors import query_vector
from lodestar.operators.search import SearchInput, fused, group_hits, permitted, query_terms, search

#: Chunk numbers of a block, as a power of two: the most that one row of postings covers.
BLOCK_BITS = 12
#: Chunks of a task after which the next block begins.
SEGMENT_ROWS = 1 << 16
#: A chunk's number is its generation, the task that wrote it, and its place there: so many bits are the place's, 20 the task's.
TASK_BITS = 28
POSTING = "term string, block long, n int, ids binary, counts binary, positions binary"
PLACE = "place int, block long, ids binary, numbers binary"


def _starts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it in one of the columns; the first row always does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Table]]:
    """The chunks of a block that lie next to each other: the block, their numbers in it in ascending order, and their rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("chunk_id").to_numpy() >> BLOCK_BITS
        for i, j in zip(*_starts(_begins(block)), strict=True) if len(block) else ():
            if held and held[0].column("chunk_id")[0].as_py() >> BLOCK_BITS != block[i]:
                yield _numbered(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield _numbered(held)


def _numbered(held: list[pa.RecordBatch]) -> tuple[int, np.ndarray, pa.Table]:
    part = pa.Table.from_batches(held).combine_chunks()
    ids = part.column("chunk_id").to_numpy()
    if (ids[1:] < ids[:-1]).any():
        part = part.sort_by("chunk_id").combine_chunks()
        ids = part.column("chunk_id").to_numpy()
    return int(ids[0] >> BLOCK_BITS), ids & ((1 << BLOCK_BITS) - 1), part


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (chunk_id, terms) as rows of postings, block by block."""
    for block, number, part in _blocks(batches):
        lists = part.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        said = lists.flatten().dictionary_encode()
        if not len(said):
            continue
        code, chunk = said.indices.to_numpy(), np.repeat(number, sizes)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # occurrences come by chunk and position, and stay so inside a term
        order = np.argsort(code, kind="stable")
        code, chunk, pos = code[order], chunk[order], pos[order]
        term_new = _begins(code)
        starts, ends = _starts(_begins(code, chunk))
        first, end = _starts(term_new)
        gaps = np.diff(pos, prepend=0)
        gaps[starts] = pos[starts]
        held, counts = chunk[starts], ends - starts
        a, b = np.searchsorted(starts, first), np.searchsorted(starts, end)
        steps = np.diff(held, prepend=0)
        steps[a] = held[a]
        terms = said.dictionary.take(pa.array(code[first]))
        yield pa.RecordBatch.from_arrays(
            [terms, pa.array(np.full(len(first), block)), pa.array(b - a, pa.int32()), packed_runs(steps, a, b), packed_runs(counts, a, b), packed_runs(gaps, first, end)],
            names=["term", "block", "n", "ids", "counts", "positions"],
        )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (chunk_id, vector) as rows of places: what isn't zero, block by block."""
    for block, number, part in _blocks(batches):
        lists = part.column("vector").combine_chunks()
        flat, width = lists.flatten().to_numpy(zero_copy_only=False), len(lists.flatten()) // max(len(lists), 1)
        table = flat.reshape(-1, width).T if width else np.zeros((0, 0), np.int16)
        some = [(k, np.flatnonzero(row)) for k, row in enumerate(table)]
        some = [(k, at) for k, at in some if len(at)]
        if some:
            ids = [packed(np.diff(number[at], prepend=0)) for _, at in some]
            numbers = [packed(table[k][at]) for k, at in some]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array(np.full(len(some), block)), pa.array(ids, pa.binary()), pa.array(numbers, pa.binary())], names=["place", "block", "ids", "numbers"])


def covers(chunk: np.ndarray, position: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that hold all terms, and their sums over minimal covers of 0.1 / (1 + noise); rows sorted by chunk and position."""
    base = np.append(True, chunk[1:] != chunk[:-1])
    number = np.cumsum(base) - 1
    begin = np.flatnonzero(base)[number]
    index = np.arange(len(chunk))
    start = np.full(len(chunk), len(chunk))
    for k in range(terms):
        start = np.minimum(start, np.maximum.accumulate(np.where(term == k, index, -1)))
    inside = start >= begin
    # the first row that closes a cover with its start
    fresh = inside & np.append(True, (start[1:] != start[:-1]) | base[1:])
    i, s = index[fresh], start[fresh]
    noise = (position[i] - position[s]) - (i - s)
    score = np.bincount(number[i], weights=0.1 / (1 + noise), minlength=number[-1] + 1 if len(number) else 0)
    whole = np.zeros(len(score), bool)
    whole[number[inside]] = True
    return chunk[np.flatnonzero(base)][whole], score[whole]


class SearchIndex:
    """The index at ``at``, a folder that the driver and all executors share. It holds all chunks that were added; with ``most`` only so many first ones of an object are found."""

    def __init__(self, spark: SparkSession, at: str, most: int | None = None):
        self.spark, self.at, self.most = spark, at.rstrip("/"), most

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.at, *parts)))

    def _system(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return is_file(self.spark, f"{self.at}/g0/READY")

    def _generations(self) -> int:
        n = 0
        while is_file(self.spark, f"{self.at}/g{n}/READY"):
            n += 1
        return n

    def table(self, name: str) -> DataFrame:
        """A table over all generations."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.at}/g{g}/{name}") for g in range(self._generations())])

    def add(self, rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> None:
        """Writes chunks (``index_rows``) as the next generation; older chunks of their objects are hidden from then on.

        A generation counts once its mark stands, so a build that stops half-way leaves nothing that is read.
        """
        generation = self._generations()
        at = f"{self.at}/g{generation}-{uuid.uuid4().hex}"
        # a task numbers its chunks by itself: the task, the segment of the task and the chunk in it, which begins at a block of its own
        place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
        length = -(-segment_rows >> BLOCK_BITS) << BLOCK_BITS
        segment = F.floor(place / segment_rows)
        number = segment * length + place % segment_rows
        task = F.shiftright("_place", 33)
        chunk = F.lit(generation << 48) + F.shiftleft(task, TASK_BITS) + number
        rows.withColumn("_place", F.monotonically_increasing_id()).withColumns({"chunk_id": chunk, "generation": F.lit(generation)}).drop("_place").write.parquet(f"{at}/chunks")
        chunks = self.spark.read.parquet(f"{at}/chunks")
        posted = chunks.select("chunk_id", "terms").mapInArrow(_posted, POSTING).sortWithinPartitions("term", "block")
        posted.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{at}/postings")
        self.spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.sum("n").alias("chunks"), F.count("*").alias("blocks")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        chunks.select("chunk_id", "vector").mapInArrow(_placed, PLACE).sortWithinPartitions("place", "block").write.parquet(f"{at}/places")
        chunks.select("object_id", "generation").distinct().write.parquet(f"{at}/objects")
        system = self._system()
        if not system.rename(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at), self._path(f"g{generation}")):
            if is_file(self.spark, f"{self.at}/g{generation}/READY"):
                return  # another session was first
            raise OSError(f"{at} can't be renamed")
        system.create(self._path(f"g{generation}", "READY")).close()

    def keys(self) -> DataFrame:
        """``chunk_id``, ``object_id``, ``ordinal``, ``norm`` and versions of the chunks that count: those of each object's last generation."""
        kept = self.table("chunks").select("chunk_id", "generation", "object_id", "ordinal", "norm", "pipeline_version", "model_version")
        if self.most is not None:
            kept = kept.filter(F.col("ordinal") < self.most)
        if self._generations() == 1:
            return kept.drop("generation")
        later = self.table("objects").groupBy("object_id").agg(F.max("generation").alias("_last")).filter("_last > 0")
        return kept.join(later, "object_id", "left").filter("_last IS NULL OR generation = _last").drop("generation", "_last")

    def term_frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many chunks each of a query's terms is; hidden chunks count too."""
        found = self.table("terms").filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("chunks").alias("n")).collect()
        return {r.term: r.n for r in found}

    def fulltext_scores(self, query: str) -> DataFrame:
        """``chunk_id`` and ``score`` of the chunks that hold all terms, by cover density."""
        terms = query_terms(query)
        known = self.term_frequencies(terms) if terms else {}
        if not terms or len(known) < len(terms):
            return self.spark.createDataFrame([], "chunk_id long, score double")
        posted = self.table("postings")
        rows = None
        for k, term in enumerate(sorted(terms, key=lambda t: (known[t], t))):
            one = posted.filter(F.col("term") == term).select("block", *[F.col(c).alias(f"{c}{k}") for c in ("ids", "counts", "positions")])
            rows = one if rows is None else rows.join(one, "block")
        n = len(terms)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, scores = [], []
                for row in batch.to_pylist():
                    held = [np.cumsum(unpacked(row[f"ids{k}"])) for k in range(n)]
                    both = held[0]
                    for other in held[1:]:
                        both = both[np.isin(both, other, assume_unique=True)]
                    if not len(both):
                        continue
                    chunk, at, term = [], [], []
                    for k in range(n):
                        counts, gaps = unpacked(row[f"counts{k}"]), unpacked(row[f"positions{k}"])
                        ends = np.cumsum(counts)
                        total = np.cumsum(gaps)
                        before = np.where(ends - counts > 0, total[np.maximum(ends - counts - 1, 0)], 0)
                        own = np.repeat(np.isin(held[k], both, assume_unique=True), counts)
                        chunk.append(np.repeat(held[k], counts)[own])
                        at.append((total - np.repeat(before, counts))[own])
                        term.append(np.full(int(own.sum()), k))
                    chunk, at, term = np.concatenate(chunk), np.concatenate(at), np.concatenate(term)
                    order = np.lexsort((at, chunk))
                    found, score = covers(chunk[order], at[order], term[order], n)
                    ids.append(found + (row["block"] << BLOCK_BITS))
                    scores.append(np.round(score, 9))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["chunk_id", "score"])

        return rows.mapInArrow(scored, "chunk_id long, score double")

    def vector_products(self, query: str) -> DataFrame:
        """``chunk_id`` and ``product`` with the query's hashed embedding, of the chunks that share a place with it."""
        weights = {place: w for place, w in enumerate(query_vector(query)) if w}
        posted = self.table("places").filter(F.col("place").isin(list(weights) or [-1]))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in whole_runs(batches, ["block"]):
                first, end = _starts(changes(part, ["block"]))
                blocks, places = part.column("block").to_numpy(), part.column("place").to_numpy()
                ids, numbers = part.column("ids").to_pylist(), part.column("numbers").to_pylist()
                for i, j in zip(first, end, strict=True):
                    total, seen = np.zeros(1 << BLOCK_BITS), np.zeros(1 << BLOCK_BITS, bool)
                    for k in range(i, j):
                        at = np.cumsum(unpacked(ids[k]))
                        total[at] += weights[int(places[k])] * unpacked(numbers[k])
                        seen[at] = True
                    at = np.flatnonzero(seen)
                    yield pa.RecordBatch.from_arrays([pa.array(at + (int(blocks[i]) << BLOCK_BITS)), pa.array(total[at])], names=["chunk_id", "product"])

        return posted.repartition("block").sortWithinPartitions("block", "place").mapInArrow(summed, "chunk_id long, product double")

    def _read(self, rows: list[Row]) -> DataFrame:
        """Candidates with their ``content``: a few hundred rows at most, whose texts are found by number."""
        schema = "file_id long, name string, ordinal int, chunk_id long, score double"
        held = self.spark.createDataFrame([tuple(r[c] for c in ("file_id", "name", "ordinal", "chunk_id", "score")) for r in rows], schema)
        numbers = sorted({r.chunk_id for r in rows})
        texts = self.table("chunks").filter(F.col("chunk_id").isin(numbers)).select("chunk_id", "content")
        return texts.join(F.broadcast(held), "chunk_id").select("file_id", "name", "ordinal", "content", "score")

    def _best(self, hits: DataFrame, entries: DataFrame, wanted: SearchInput) -> DataFrame:
        files = permitted(entries, wanted).select(F.col("file_id").cast("long").alias("file_id"), "name", "object_id")
        rows = hits.join(files, "object_id").select("file_id", "name", "ordinal", "chunk_id", "score")
        return rows.orderBy(F.desc("score"), "file_id", "ordinal").limit(wanted.candidates)

    def fulltext_candidates(self, entries: DataFrame, wanted: SearchInput) -> DataFrame:
        """As ``search.fulltext_candidates``, from postings."""
        wanted = wanted.checked()
        hits = self.keys().join(self.fulltext_scores(wanted.query), "chunk_id")
        return self._read(self._best(hits, entries, wanted).collect())

    def semantic_candidates(self, entries: DataFrame, wanted: SearchInput) -> DataFrame:
        """As ``search.semantic_candidates``, exact, from the postings of the query's places.

        Chunks that share no place have a cosine of 0: they are looked for only if fewer than the wanted number are above that.
        """
        wanted = wanted.checked()
        keys = self.keys().filter("norm > 0")
        for column, version in (("pipeline_version", wanted.pipeline_version), ("model_version", wanted.model_version)):
            if version is not None:
                keys = keys.filter(F.col(column) == version)
        products = self.vector_products(wanted.query)
        score: Column = F.round(F.col("product") / F.col("norm"), 9)
        above = keys.join(products.filter("product > 0"), "chunk_id").withColumn("score", score).filter("score > 0")
        best = self._best(above, entries, wanted).collect()
        if len(best) < wanted.candidates:
            whole = keys.join(products, "chunk_id", "left").withColumn("score", F.coalesce(score, F.lit(0.0)))
            best = self._best(whole, entries, wanted).collect()
        return self._read(best)

    def search(self, entries: DataFrame, wanted: SearchInput) -> DataFrame:
        """As ``search.search``, with this index in place of the chunks."""
        wanted = wanted.checked()
        if wanted.mode == "name":
            return search(entries, entries, wanted)
        if wanted.mode == "fulltext":
            return group_hits(self.fulltext_candidates(entries, wanted), wanted.limit)
        if wanted.mode == "semantic":
            return group_hits(self.semantic_candidates(entries, wanted), wanted.limit)
        return fused(self.fulltext_candidates(entries, wanted), self.semantic_candidates(entries, wanted), wanted.limit)


def content_key(spark: SparkSession, *paths: str) -> str:
    """A hash of names, sizes and times of the files under ``paths``: another one as soon as a table is rewritten."""
    hadoop, found = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for path in paths:
        at = hadoop.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = system.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


