"""Tables that are stored in buckets of a key, so that joins on it read them without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.checkpoints import is_file

#: Buckets of a table; two tables join without a shuffle if they have as many.
BUCKETS = 64


def write_bucketed(df: DataFrame, at: str, key: str, buckets: int = BUCKETS) -> None:
    """Writes a table in buckets of ``key``, sorted by it inside; each bucket is one file."""
    spark, name = df.sparkSession, _name(at)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", at).saveAsTable(name)


def read_bucketed(spark: SparkSession, at: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A table of ``write_bucketed``; a session that hasn't seen it registers its folder."""
    name = _name(at)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(at).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def is_written(spark: SparkSession, at: str) -> bool:
    return is_file(spark, f"{at}/_SUCCESS")


def _name(at: str) -> str:
    return "lodestar_" + "".join(c if c.isalnum() else "_" for c in at.rstrip("/").rpartition("/")[2].lower())
