"""The drive's tables over the analytic tables that a deployment has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWNERS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct content: ``object_id`` (its hash), ``size_bytes``, ``text``. Equal texts meet in the task that reads them and then once more, so each text is sent once by a task."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("object_id"), "text")
    return docs.groupBy("object_id").agg(F.min("text").alias("text")).select("object_id", "text", F.octet_length("text").cast("long").alias("size_bytes"))


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by ``sha256`` and ``size_bytes``, with ``status``: some are on their way out. No text is shuffled."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    keyed = docs.select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), "doc_id")
    turn = F.min("doc_id") % 7
    return keyed.groupBy("sha256", "size_bytes").agg(F.when(turn == 0, "deleting").when(turn == 1, "deleted").otherwise("ready").alias("status"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical files, one per document, with name (after the part of the same number), folder, owner, MIME type and deletion mark."""
    docs = table(spark, sf_dir, "documents")
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    kinds = F.array(*map(F.lit, ("text/plain", "text/markdown; charset=utf-8", "application/json", "text/html")))
    name = F.lower(F.concat(F.coalesce("p_name", F.lit("file")), F.lit("-"), "doc_id", F.lit(".txt")))
    return docs.join(names, F.col("doc_id") == F.col("p_partkey"), "left").select(
        F.col("doc_id").alias("file_id"),
        F.pmod("doc_id", F.lit(OWNERS)).alias("owner_id"),
        F.col("source").alias("folder_id"),
        F.sha2("text", 256).alias("object_id"),
        name.alias("name"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size_bytes"),
        F.get(kinds, F.pmod("doc_id", F.lit(4)).cast("int")).alias("mime_type"),
        (F.pmod("doc_id", F.lit(23)) == 0).alias("deleted"),
    )


ENTRIES_SQL = f"""
    SELECT doc_id AS file_id, doc_id % {OWNERS} AS owner_id, source AS folder_id, sha256(text) AS object_id,
           lower(coalesce(p_name, 'file') || '-' || doc_id || '.txt') AS name, strlen(coalesce(text, ''))::BIGINT AS size_bytes,
           ['text/plain', 'text/markdown; charset=utf-8', 'application/json', 'text/html'][doc_id % 4 + 1] AS mime_type, doc_id % 23 = 0 AS deleted
    FROM documents LEFT JOIN part ON doc_id = p_partkey"""


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index status per object: a label of good quality means indexed, a bad one failed."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("object_id"))
    return docs.join(labels, "doc_id").groupBy("object_id").agg(F.when(F.max("quality") == 1, "indexed").otherwise("failed").alias("status"))


STATUS_SQL = """
    SELECT sha256(text) AS object_id, CASE WHEN max(quality) = 1 THEN 'indexed' ELSE 'failed' END AS status
    FROM documents JOIN labels USING (doc_id) GROUP BY 1"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree: root, regions, nations, suppliers and customers."""
    one = lambda t, i, p, n: table(spark, sf_dir, t).select(i.alias("folder_id"), p.alias("parent_id"), F.col(n).alias("name"))
    key = lambda mark, c: F.concat(F.lit(mark), c)
    root = spark.range(1).select(F.lit("root").alias("folder_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("/").alias("name"))
    return (
        root.unionByName(one("region", key("r", "r_regionkey"), F.lit("root"), "r_name"))
        .unionByName(one("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name"))
        .unionByName(one("supplier", key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name"))
        .unionByName(one("customer", key("c", "c_custkey"), key("n", "c_nationkey"), "c_name"))
    )


FOLDERS_SQL = """
    SELECT 'root' AS folder_id, NULL::VARCHAR AS parent_id, '/' AS name
    UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer"""
