"""The folder that driver and executors share: checkpoints, streams and indexes live there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` as a URI; where that is unset a local master gets a temporary one for the session."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodestar-")
        context.setCheckpointDir(at)
    path = context._jvm.org.apache.hadoop.fs.Path(at.rstrip("/"))
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole if "://" in whole else whole.replace("file:/", "file:///", 1)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    at = shared_dir(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return df.checkpoint()


def stream_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for a streaming query's checkpoint and rows, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether something lies at ``path``, in whatever file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(at) and system.getFileStatus(at).isDirectory()
