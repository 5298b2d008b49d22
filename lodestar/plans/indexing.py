"""Indexing by a provider, metrics of a build, and tables that join without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.checkpoints import shared_dir, stream_dir
from lodestar.operators import documents, providers, search
from lodestar.operators.index import content_key
from lodestar.plans.registry import ORACLES, query
from lodestar.plans.retrieval import WANTED, indexed_chunks, shown
from lodestar.plans.texts import CHUNKS_SQL
from lodestar.sources import bucketed
from lodestar.sources.drive import ENTRIES_SQL, entries, objects
from lodestar.streaming.metrics import observed


class FakeProvider:
    """Vectors of three numbers; a call with a text of under ninety characters fails, and a text whose length divides by 97 gets a fourth number."""

    model = "fake"

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any(len(t) < 90 for t in texts):
            raise ConnectionError("the provider isn't there")
        return [[float(len(t))] * (4 if len(t) % 97 == 0 else 3) for t in texts]


@query(
    "provider_outcomes",
    f"""WITH c AS ({CHUNKS_SQL}), calls AS (SELECT object_id, ordinal // 10 AS call, bool_or(length(content) < 90) AS broken FROM c GROUP BY ALL),
        v AS (SELECT c.object_id, ordinal, CASE WHEN broken THEN 'ai.embedding_failed' WHEN length(content) % 97 = 0 THEN 'ai.persistence_failed' END AS code FROM c JOIN calls ON calls.object_id = c.object_id AND call = ordinal // 10),
        d AS (SELECT object_id, arg_min(code, ordinal) FILTER (code IS NOT NULL) AS code FROM v GROUP BY object_id),
        o AS (SELECT DISTINCT sha256(text) AS object_id, text, strlen(text) AS size FROM documents WHERE text IS NOT NULL)
        SELECT object_id, CASE WHEN size % 31 = 0 THEN 'failed' WHEN d.object_id IS NULL THEN 'unsupported' WHEN code IS NULL THEN 'indexed' ELSE 'failed' END AS outcome,
               CASE WHEN size % 31 = 0 THEN 'ai.object_read_failed' WHEN d.object_id IS NULL THEN 'ai.empty_content' ELSE code END AS error_code FROM o LEFT JOIN d USING (object_id)""",
)
def provider_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object's way to the index: reading, of which some fail; extraction; and a provider whose calls may fail."""
    stored = objects(spark, sf_dir)
    read = stored.select("object_id", F.when(F.col("size_bytes") % 31 == 0, F.col("size_bytes") - 1).otherwise(F.col("size_bytes")).alias("size_bytes"))
    extracted = documents.extraction_outcomes(stored.select("object_id", "text", F.lit(None).cast("string").alias("error")))
    embedded = providers.embedded(documents.chunked(stored), FakeProvider(), dimension=3)
    return providers.document_outcomes(providers.read_outcomes(stored, read), extracted, providers.embedding_outcomes(embedded))


@query("observed_index", f"WITH c AS ({CHUNKS_SQL}) SELECT count(*) AS chunks, count(DISTINCT object_id) AS objects, sum(length(content))::BIGINT AS characters, count(*) FILTER (length(content) < 90) AS short FROM c")
def observed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a write of all chunks, taken while they are written."""
    first = F.count_if(F.col("ordinal") == 0)
    chunks, seen = observed(documents.chunked(objects(spark, sf_dir)), chunks=F.count("*"), objects=first, characters=F.sum(F.length("content")), short=F.count_if(F.length("content") < 90))
    chunks.write.parquet(stream_dir(spark, "observed"))
    counts = seen.get
    return spark.createDataFrame([(counts["chunks"], counts["objects"], counts["characters"], counts["short"])], "chunks long, objects long, characters long, short long")


def stored_by_object(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and indexed chunks in buckets of their object, in the shared folder under a key of the tables' files."""
    key = content_key(spark, *[f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "part")])
    files, chunks = f"{shared_dir(spark)}/entries-{key}", f"{shared_dir(spark)}/chunks-{key}"
    if not bucketed.is_written(spark, files):
        bucketed.write_bucketed(entries(spark, sf_dir), files, "object_id")
    if not bucketed.is_written(spark, chunks):
        bucketed.write_bucketed(indexed_chunks(spark, sf_dir).select("object_id", "ordinal", "content", "terms"), chunks, "object_id")
    return bucketed.read_bucketed(spark, files, "object_id"), bucketed.read_bucketed(spark, chunks, "object_id")


@query("bucketed_search", ORACLES["fulltext_search"])
def bucketed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``fulltext_search`` from bucketed tables: nothing is exchanged below the best rows."""
    return shown(search.fulltext_candidates(*stored_by_object(spark, sf_dir), WANTED))


READY = f"""WITH e AS ({ENTRIES_SQL}), o AS (SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, CASE min(doc_id) % 7 WHEN 0 THEN 'deleting' WHEN 1 THEN 'deleted' ELSE 'ready' END AS status
    FROM documents WHERE text IS NOT NULL GROUP BY ALL)"""


@query("ready_entries", f"{READY} SELECT file_id, sha256, o.size_bytes FROM e JOIN o ON object_id = sha256 AND e.size_bytes = o.size_bytes WHERE NOT deleted AND status = 'ready'")
def ready_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files whose object, known by hash and size, is ready."""
    from lodestar.operators.objects import ready_files
    from lodestar.sources.drive import stored_objects

    return ready_files(entries(spark, sf_dir), stored_objects(spark, sf_dir)).select("file_id", "sha256", "size_bytes")
