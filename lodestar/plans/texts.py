"""Queries over text: normalising, chunks, tags, embeddings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text, vectors
from lodestar.operators import documents
from lodestar.plans.registry import query
from lodestar.sources.drive import document_status, objects, table

CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
LAST_CHUNK = "greatest(0, ceil((length(clean) - 1200) / 1040.0)::BIGINT)"


def chunks_sql(last: str) -> str:
    return f"""
    SELECT object_id, ordinal::INT AS ordinal, substr(clean, ordinal * 1040 + 1, 1200) AS content
    FROM (SELECT object_id, clean, unnest(range(0, 1 + {last})) AS ordinal
          FROM (SELECT DISTINCT sha256(text) AS object_id, {CLEAN} AS clean FROM documents WHERE text IS NOT NULL) WHERE length(clean) > 0)"""


CHUNKS_SQL = chunks_sql(f"least(255, {LAST_CHUNK})")
WHOLE_CHUNKS_SQL = chunks_sql(LAST_CHUNK)


@query("normalize_text", f"SELECT doc_id, md5({CLEAN}) AS clean_md5, length({CLEAN})::INT AS runes, substr({CLEAN}, 1, 320) AS excerpt FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.collapsed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).alias("runes"), text.excerpt(F.col("text")).alias("excerpt"))


@query("chunk_documents", f"SELECT object_id, ordinal, length(content)::INT AS runes, md5(content) AS content_md5 FROM ({CHUNKS_SQL})")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunked(objects(spark, sf_dir)).select("object_id", "ordinal", F.length("content").alias("runes"), F.md5("content").alias("content_md5"))


@query("token_estimate", f"SELECT object_id, sum(length(content) // 2)::BIGINT AS tokens FROM ({CHUNKS_SQL}) GROUP BY object_id")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunked(objects(spark, sf_dir)).groupBy("object_id").agg(F.sum(text.token_estimate(F.col("content"))).alias("tokens"))


@query(
    "detect_language",
    """SELECT conv_id, turn, language FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM conversations)
       UNION ALL SELECT -1::BIGINT, 0::BIGINT, 'zh'""",
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("数据 data").alias("text")))
    return rows.select("conv_id", "turn", text.language(F.col("text")).alias("language"))


@query("summarize", f"SELECT doc_id, CASE WHEN length({CLEAN}) > 240 THEN substr({CLEAN}, 1, 237) || '...' ELSE {CLEAN} END AS summary FROM documents")
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


TRIM_SQL = r"regexp_replace(w, '^[.,!?;:()\[\]{}\"''，。！？；：（）【】]+|[.,!?;:()\[\]{}\"''，。！？；：（）【】]+$', '', 'g')"


@query(
    "document_tags",
    rf"""WITH w AS (SELECT object_id, unnest(regexp_split_to_array(trim(lower(text)), '\s+')) AS w FROM (SELECT DISTINCT sha256(text) AS object_id, text FROM documents)),
         t AS (SELECT object_id, {TRIM_SQL} AS word FROM w),
         c AS (SELECT object_id, word, count(*) AS n FROM t WHERE length(word) >= 3 GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY n DESC, word) AS place FROM c)
         SELECT object_id, string_agg(word, ' ' ORDER BY place) AS tags FROM r WHERE place <= 5 GROUP BY object_id""",
)
def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.tags(objects(spark, sf_dir)).select("object_id", F.array_join("tags", " ").alias("tags"))


HASHED_SQL = """
    SELECT k, ('0x' || substr(h, 4 * o + 1, 4))::INT % 1024 AS bucket, CASE WHEN ('0x' || substr(h, 33 + 2 * o, 2))::INT % 2 = 1 THEN -1 ELSE 1 END AS sign
    FROM (SELECT k, sha256(w) AS h, unnest(range(0, 4)) AS o FROM ({words}) WHERE w <> '')"""


@query(
    "hash_embedding",
    f"""WITH b AS ({HASHED_SQL.format(words="SELECT struct_pack(c := conv_id, t := turn) AS k, unnest(regexp_split_to_array(lower(text), '[[:space:]]+')) AS w FROM conversations")}),
        s AS (SELECT k, bucket, sum(sign) AS v FROM b GROUP BY ALL HAVING v <> 0)
        SELECT k.c AS conv_id, k.t AS turn, bucket::INT AS bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY k)), 6) AS value FROM s""",
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse form of every turn's vector: non-zero buckets and their values."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", vectors.hashed_buckets(F.col("text")).alias("codes"))
    rows = turns.withColumn("norm", vectors.bucket_norm(F.col("codes"))).select("conv_id", "turn", "norm", F.explode("codes").alias("code"))
    sums = rows.groupBy("conv_id", "turn", F.floor(F.col("code") / 2).cast("int").alias("bucket")).agg(F.sum(1 - 2 * (F.col("code") % 2)).alias("v"), F.max("norm").alias("norm"))
    return sums.filter("v <> 0").select("conv_id", "turn", "bucket", F.round(F.col("v") / F.col("norm"), 6).alias("value"))


@query(
    "index_outcomes",
    """SELECT object_id, outcome, CASE WHEN outcome = 'unsupported' THEN CASE WHEN large THEN 'ai.object_too_large' ELSE 'ai.unsupported_type' END END AS error_code FROM (
         SELECT p.page_id AS object_id, strlen(html) > 4000 AS large, CASE WHEN p.url LIKE 'https:%' THEN 'current' WHEN p.page_id % 2 = 1 OR strlen(html) > 4000 THEN 'unsupported' ELSE 'process' END AS outcome FROM pages p)""",
)
def index_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files whose names and types alternate: HTML is read only as an octet stream with a source name. Those of secure sites are indexed, and 4000 bytes are the most."""
    pages = table(spark, sf_dir, "pages")
    name = F.concat("page_id", F.lit(".html"))
    raw = F.when(F.col("page_id") % 2 == 1, "text/html").otherwise("application/octet-stream")
    files = pages.select(F.col("page_id").alias("object_id"), F.octet_length("html").alias("size_bytes"), text.effective_mime(raw, name).alias("mime_type"))
    known = pages.filter("url LIKE 'https:%'").select(F.col("page_id").alias("object_id"), F.lit("indexed").alias("status"), F.lit("p2").alias("pipeline_version"), F.lit("m1").alias("model_version"))
    return documents.index_outcomes(files, known, "p2", "m1", most_bytes=4000)


@query("stored_chunks", f"SELECT object_id, ordinal, md5(content) AS content_md5 FROM ({CHUNKS_SQL})")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, first written with other content for labelled documents, which are then indexed again."""
    from lodestar.functions.checkpoints import stream_dir

    at = stream_dir(spark, "chunks")
    labelled = document_status(spark, sf_dir).select("object_id", F.lit(True).alias("labelled"))
    # chunks are cut once: each further use would send all texts again
    documents.chunked(objects(spark, sf_dir)).join(labelled, "object_id", "left").write.parquet(f"{at}-once")
    once = spark.read.parquet(f"{at}-once")
    rows, again = (once.filter(kind).drop("labelled") for kind in ("labelled IS NULL", "labelled"))
    stale = again.select("object_id", (F.col("ordinal") + 1).alias("ordinal"), F.lit("stale").alias("content"))
    documents.replace_chunks(rows.unionByName(stale), at, 16)
    documents.replace_chunks(again, at, 16)
    return spark.read.parquet(at).select("object_id", "ordinal", F.md5("content").alias("content_md5"))


TASK_SQL = """
    WITH log AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key, event_id, ts,
                        CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'requested' END AS kind FROM events)
    SELECT dedupe_key, arg_min(event_id, (ts, event_id)) FILTER (kind = 'requested') AS task_id, count(*) FILTER (kind = 'requested') AS requests,
           coalesce(arg_max(kind, (ts, event_id)) FILTER (kind <> 'requested'), 'pending') AS status FROM log GROUP BY dedupe_key HAVING count(*) FILTER (kind = 'requested') > 0"""


@query("reprocess_tasks", TASK_SQL)
def reprocess_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of tasks, one task per user and day."""
    step = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("requested")
    key = F.concat(F.col("user_id"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd"))
    return documents.task_states(table(spark, sf_dir, "events").select(key.alias("dedupe_key"), "event_id", "ts", step.alias("kind")))


@query(
    "decode_text",
    r"""SELECT doc_id::VARCHAR AS object_id, CASE WHEN NOT bad THEN length(text) END::INT AS runes, CASE WHEN NOT bad THEN md5(text) END AS text_md5, CASE WHEN bad THEN 'invalid: ValueError' END AS error
        FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS bad FROM documents)""",
)
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes through the extraction path: those of even ids in UTF-8, those of odd ids in GB18030."""
    from lodestar.sources.content import extracted, pieces

    def encoded(batches):
        for batch in pieces(batches):
            out = [(t or "").encode("gb18030" if i % 2 else "utf-8") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(encoded, "doc_id long, content binary")
    files = docs.select(F.col("doc_id").cast("string").alias("object_id"), F.lit("text/plain").alias("mime_type"), "content")
    return extracted(files).select("object_id", F.length("text").alias("runes"), F.md5("text").alias("text_md5"), "error")
