"""Helpers that several operators share: tables, the shared folder, words of Arrow columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python task works on at a time; one longer text is a piece of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset a temporary folder is taken, but only for a local master.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodestar-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, as a URI; a folder without a scheme lies in the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return at if "://" in at else at.replace("file:/", "file:///", 1)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of whole rows; columns that hold maps count as their JSON text."""
    parts = [F.to_json(F.struct(_named(f.name))) if _has_map(f.dataType) else _named(f.name) for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *parts)


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are written: it does so once the driver's collectors find them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def mapped_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` of a function that adds columns, whatever the names of the others: those with a dot have another name inside it."""
    outside = {c: safe for c, safe in zip(df.columns, free_names(df, *["c" for _ in df.columns]), strict=True) if "." in c}
    inner = df.toDF(*[outside.get(c, c) for c in df.columns]) if outside else df
    out = inner.mapInArrow(f, T.StructType([*inner.schema.fields, *added]))
    return out.toDF(*df.columns, *[x.name for x in added]) if outside else out


def sized(text: Column | str) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column | str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null; JVM side."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about ``most`` bytes of text each, without copying."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows: row offsets (rows + 1) and the flat words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return kept_parts(parts)


def kept_parts(parts: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column without its empty strings."""
    offsets = np.asarray(parts.offsets.to_numpy(), dtype=np.int64)
    flat = parts.flatten()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    counted = np.concatenate([[0], np.cumsum(mask)])
    return counted[offsets], flat.filter(full)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets; 0 for empty rows."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
