"""Content-addressed objects: canonical entries, reference counts, garbage, functional table changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(entries: DataFrame, order: str = "file_id") -> DataFrame:
    """Live entries with ``canonical_id``, the first of an owner's entries of the same content, and ``position`` from 1."""
    own = Window.partitionBy("owner_id", "object_id").orderBy(order)
    live = entries.filter(~F.col("deleted"))
    return live.withColumns({"canonical_id": F.first(order).over(own), "position": F.row_number().over(own)})


def reference_counts(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """``object_id``, ``size_bytes`` and ``references``, the live entries of each object (0 if none)."""
    live = entries.filter(~F.col("deleted")).groupBy("object_id").agg(F.count("*").alias("n"))
    return objects.select("object_id", "size_bytes").join(live, "object_id", "left").select("object_id", "size_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("references"))


def garbage(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """Objects without a live entry."""
    return objects.select("object_id", "size_bytes").join(entries.filter(~F.col("deleted")), "object_id", "left_anti")


def released_bytes(entries: DataFrame) -> DataFrame:
    """Bytes that each owner gets back when duplicates of the same content go."""
    extra = canonical(entries).filter(F.col("position") > 1)
    return extra.groupBy("owner_id").agg(F.sum("size_bytes").alias("released_bytes"), F.count("*").alias("entries"))


def deduplicated(entries: DataFrame) -> DataFrame:
    """All entries as the one-off migration leaves them: duplicates ``tombstoned`` and pointing to the canonical entry."""
    marks = canonical(entries).select("file_id", "canonical_id", (F.col("position") > 1).alias("tombstoned"))
    return entries.join(marks, "file_id", "left").select(
        "file_id", "owner_id", "object_id", F.coalesce("canonical_id", "file_id").alias("canonical_id"), (F.col("deleted") | F.coalesce("tombstoned", F.lit(False))).alias("deleted")
    )


def visible_objects(objects: DataFrame, entries: DataFrame, owner_id: int) -> DataFrame:
    """Objects that an owner has a live entry of; others' content is never seen."""
    return objects.join(entries.filter(~F.col("deleted") & (F.col("owner_id") == owner_id)), "object_id", "left_semi")


def file_view(entries: DataFrame, objects: DataFrame, status: DataFrame) -> DataFrame:
    """Live files with their object's size and, if there is one, the document's status."""
    live = entries.filter(~F.col("deleted")).drop("size_bytes")
    return live.join(objects.select("object_id", "size_bytes"), "object_id").join(status, "object_id", "left").select("file_id", "owner_id", "folder_id", "name", "size_bytes", "mime_type", "status")


def inserted_or_ignored(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``current`` and those rows of ``new`` whose key it hasn't; of equal keys the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = new.withColumn("_place", place).filter("_place = 1").drop("_place")
    return current.unionByName(first.join(current, keys, "left_anti"))


def upserted(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``, which must be total for equal results in every run."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def compare_and_set(current: DataFrame, commands: DataFrame, key: str = "file_id") -> DataFrame:
    """Verdict of each command (``key``, expected_version, ...): ``applied``, ``conflict`` or ``not_found``, and the version after it.

    Of several commands on one row at the right version the one with the smallest ``command_id`` applies.
    """
    rows = current.select(key, "version")
    right = F.col("version") == F.col("expected_version")
    joined = commands.join(rows, key, "left")
    first = F.min(F.when(right, F.col("command_id"))).over(Window.partitionBy(key))
    verdict = F.when(F.col("version").isNull(), "not_found").when(right & (F.col("command_id") == first), "applied").otherwise("conflict")
    after = F.col("version") + F.when(first.isNotNull(), 1).otherwise(0)
    return joined.select("command_id", key, verdict.alias("verdict"), after.alias("version"))


def deleted_files(entries: DataFrame, commands: DataFrame) -> DataFrame:
    """Deletes of files (command_id, file_id, expected_version) against live entries with ``version``.

    Each command gets its ``verdict``, the ``released_bytes`` of the owner's quota, and ``gc_requested``: whether
    the content has no live entry left when all commands are done.
    """
    live = entries.filter(~F.col("deleted"))
    verdicts = compare_and_set(live, commands)
    applied = verdicts.filter("verdict = 'applied'").select("command_id", "file_id")
    held = live.join(applied, "file_id", "left_anti").select("object_id").distinct().withColumn("_held", F.lit(True))
    gone = live.join(applied, "file_id").join(held, "object_id", "left")
    effects = gone.select("command_id", "size_bytes", (F.col("object_id").isNotNull() & F.col("_held").isNull()).alias("gc"))
    return verdicts.join(effects, "command_id", "left").select(
        "command_id", "file_id", "verdict", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("released_bytes"), F.coalesce("gc", F.lit(False)).alias("gc_requested")
    )


def delete_list(gone: DataFrame, variants: DataFrame) -> DataFrame:
    """Keys to delete of objects without references (object_id, object_key): their own and those of their ``variants``."""
    own = gone.select("object_id", F.lit("object").alias("kind"), "object_key")
    made = variants.join(gone.select("object_id"), "object_id", "left_semi").select("object_id", F.col("variant_type").alias("kind"), "object_key")
    return own.unionByName(made)


def cascaded(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Children whose parent is kept."""
    return children.join(kept.select(key), key, "left_semi")


def latest_by(rows: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    """``value`` of the row with the largest ``order`` of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias("latest"))


def ready_files(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Live entries whose object is ``ready``; an object is known by ``sha256`` and ``size_bytes`` together."""
    ready = stored.filter("status = 'ready'").select(F.col("sha256").alias("object_id"), "size_bytes")
    return entries.filter(~F.col("deleted")).join(ready, ["object_id", "size_bytes"]).withColumn("sha256", F.col("object_id"))
