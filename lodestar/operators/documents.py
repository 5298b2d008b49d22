"""From content to chunks, tags and index outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import NOT_TERM, collapsed, extractor, trimmed_word, words
from lodestar.functions.vectors import DIMENSION, WordBuckets

CHUNK_RUNES, OVERLAP_RUNES, MOST_CHUNKS = 1200, 160, 256
MOST_OBJECT_BYTES = 32 << 20
MOST_TAGS, SHORTEST_TAG = 5, 3
#: Embeddings that a task sums up at a time.
VECTORS = 1024


def chunked(objects: DataFrame, key: str = "object_id", text: str = "text", size: int = CHUNK_RUNES, overlap: int = OVERLAP_RUNES, most: int | None = MOST_CHUNKS) -> DataFrame:
    """``key``, ``ordinal`` and ``content`` of the chunks of each text, white space collapsed.

    Chunks of ``size`` code points overlap by ``overlap``; the last ends with the text.
    A text has ``most`` chunks at most, or with None as many as it needs. Blank and null
    texts have none. Map-only, and in time that grows with the text: a match is a stride,
    or all that is left where that fits a chunk, and its group is the chunk that begins there.
    """
    stride = size - overlap
    clean = collapsed(F.col(text))
    if most is not None:
        clean = F.substring(clean, 1, most * stride + overlap)
    match = rf"(?s)(?=(.{{1,{size}}}+))(?:.{{1,{size}}}+\z|.{{{stride}}})"
    return objects.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(match), 1)).alias("ordinal", "content"))


def section_chunks(sections: DataFrame, key: str = "object_id", most: int = MOST_CHUNKS) -> DataFrame:
    """Chunks of texts in sections (``key``, ``section_no``, ``page_number``, ``section``, ``text``), capped over all sections of a key."""
    cut = chunked(sections.withColumn("_s", F.struct(key, "section_no", "page_number", "section")), "_s")
    flat = cut.select(f"_s.{key}", "_s.section_no", "_s.page_number", "_s.section", F.col("ordinal").alias("_part"), "content")
    place = F.row_number().over(Window.partitionBy(key).orderBy("section_no", "_part")) - 1
    return flat.withColumn("ordinal", place).filter(F.col("ordinal") < most).drop("_part")


def tags(objects: DataFrame, key: str = "object_id", text: str = "text", most: int = MOST_TAGS) -> DataFrame:
    """``key`` and ``tags``, the most frequent words of three characters or more, by count and then word.

    A text is one row, whose words are sorted and counted in runs: nothing is shuffled. Texts without such words are left out.
    """
    said = F.filter(F.transform(words(F.lower(F.col(text))), trimmed_word), lambda w: F.length(w) >= SHORTEST_TAG)
    pair = "array<struct<n:int,word:string>>"
    start = F.struct(F.array().cast(pair).alias("best"), F.lit("").alias("word"), F.lit(0).alias("n"))
    rank = lambda a, b: F.when(a.n != b.n, b.n - a.n).when(a.word < b.word, -1).when(a.word > b.word, 1).otherwise(0)

    def closed(acc: Column) -> Column:
        """The best words with the run that ends."""
        enough = (F.size(acc.best) < most) | (acc.n >= F.element_at(acc.best, -1).n)
        more = F.slice(F.array_sort(F.array_append(acc.best, F.struct(acc.n.alias("n"), acc.word.alias("word"))), rank), 1, most)
        return F.when((acc.n > 0) & enough, more).otherwise(acc.best)

    def step(acc: Column, w: Column) -> Column:
        same = acc.word == w
        return F.struct(F.when(same, acc.best).otherwise(closed(acc)).alias("best"), w.alias("word"), F.when(same, acc.n + 1).otherwise(1).alias("n"))

    sorted_words = objects.select(key, F.array_sort(said).alias("_w")).filter("size(_w) > 0")
    return sorted_words.select(key, F.transform(F.aggregate("_w", start, step, closed), lambda x: x.word).alias("tags"))


def replace_chunks(chunks: DataFrame, at: str, buckets: int = 64, key: str = "object_id") -> None:
    """Writes the chunks of some documents under ``at`` in place of all that these documents had there.

    The table is partitioned by a hash of the document; only the partitions of the given
    documents are rewritten, and a rerun leaves the same rows.
    """
    spark = chunks.sparkSession
    new = chunks.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows = new
    try:
        held = spark.read.schema(new.schema).parquet(at)
        touched = held.join(new.select("bucket").distinct(), "bucket", "left_semi")
        rows = new.unionByName(touched.join(new.select(key).distinct(), key, "left_anti").select(*new.columns))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)


def extraction_outcomes(sections: DataFrame, key: str = "object_id") -> DataFrame:
    """What became of each file of ``sections`` (text, error): ``outcome`` and ``error_code``.

    Unsupported and invalid content, and content without any text, end as unsupported; the rest is indexed.
    """
    seen = sections.groupBy(key).agg(F.max("error").alias("_error"), F.max(F.length(F.trim(collapsed(F.coalesce("text", F.lit("")))))).alias("_runes"))
    code = F.when(F.col("_error") == "unsupported", "ai.unsupported_type").when(F.col("_error").isNotNull(), "ai.invalid_content").when(F.col("_runes") == 0, "ai.empty_content")
    return seen.select(key, F.when(code.isNull(), "indexed").otherwise("unsupported").alias("outcome"), code.alias("error_code"))


def index_rows(chunks: DataFrame, pipeline: str, model: str, dimension: int = DIMENSION) -> DataFrame:
    """Chunks as a search index stores them: with ``terms``, the hashed embedding as ``vector`` (whole numbers), its length ``norm``, and both versions.

    Words are split and hashed once, here; a query then reads a few places of each vector.
    """
    terms = F.filter(F.split(F.lower("content"), NOT_TERM), lambda t: t != "")
    coded = chunks.select("object_id", "ordinal", "content", terms.alias("terms"), words(F.lower(F.col("content"))).alias("words"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordBuckets(dimension)
        for whole in batches:
            for at in range(0, whole.num_rows, VECTORS):
                batch = whole.slice(at, VECTORS)
                said = batch.column("words")
                sizes = np.diff(said.offsets.to_numpy())
                places, signs = known.of(said.flatten())
                rows = np.repeat(np.arange(batch.num_rows), sizes)[:, None]
                sums = np.bincount((rows * dimension + places).ravel(), weights=signs.ravel(), minlength=batch.num_rows * dimension).reshape(-1, dimension)
                norm = np.sqrt((sums * sums).sum(axis=1))
                vector = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel().astype(np.int16)), dimension).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vector, pa.array(norm)], names=[*batch.schema.names[:-1], "vector", "norm"])

    schema = T.StructType([*coded.schema.fields[:-1], T.StructField("vector", T.ArrayType(T.ShortType())), T.StructField("norm", T.DoubleType())])
    return coded.mapInArrow(summed, schema).withColumns({"pipeline_version": F.lit(pipeline), "model_version": F.lit(model)})


def task_states(log: DataFrame) -> DataFrame:
    """Tasks of a log (dedupe_key, event_id, ts, kind): equal keys are one task.

    ``task_id`` is the first request's event, ``requests`` counts them, and ``status`` is the last of
    ``running``, ``succeeded`` and ``failed``, or ``pending``. Keys without a request are no tasks.
    """
    asked = F.col("kind") == "requested"
    at = F.struct("ts", "event_id")
    tasks = log.groupBy("dedupe_key").agg(
        F.min_by("event_id", F.when(asked, at)).alias("task_id"),
        F.count_if(asked).alias("requests"),
        F.coalesce(F.max_by("kind", F.when(~asked, at)), F.lit("pending")).alias("status"),
    )
    return tasks.filter("requests > 0")


def index_outcomes(files: DataFrame, documents: DataFrame, pipeline: str, model: str, most_bytes: int = MOST_OBJECT_BYTES, readers: tuple[str, ...] = ("text", "docx")) -> DataFrame:
    """What indexing does with each object of ``files`` (object_id, size_bytes, mime_type): ``outcome`` and ``error_code``.

    Current documents (indexed by this pipeline and model) are skipped; too large and
    unsupported ones, of a kind that ``readers`` lacks, end as such; the rest is to be processed.
    """
    known = documents.select("object_id", "status", "pipeline_version", "model_version")
    current = (F.col("status") == "indexed") & (F.col("pipeline_version") == pipeline) & (F.col("model_version") == model)
    kind = extractor(F.col("mime_type"))
    unread = ~kind.isin(*readers)
    outcome = F.when(current, "current").when((F.col("size_bytes") > most_bytes) | unread, "unsupported").otherwise("process")
    code = F.when(F.col("size_bytes") > most_bytes, "ai.object_too_large").when(unread, "ai.unsupported_type")
    return files.join(known, "object_id", "left").select("object_id", outcome.alias("outcome"), F.when(outcome == "unsupported", code).alias("error_code"))
