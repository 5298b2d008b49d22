"""Folder trees: one table of paths answers scope, breadcrumb and cycle questions by filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.checkpoints import checkpointed


def folder_paths(folders: DataFrame, most_depth: int | None = None) -> DataFrame:
    """``folder_id``, ``depth`` (0 for roots) and ``path``, the ids from the root down to the folder.

    A level is one join of the frontier with the folders; rounds are as many as the tree is deep, and
    each ends in a checkpoint. Folders on a cycle or below a missing parent aren't reached. A tree deeper than
    ``most_depth`` raises an error; without it the depth has no limit, but an id on two rows that is its own ancestor, which no
    valid table holds, would never end and raises an error too.
    """
    edges = folders.select("folder_id", "parent_id")
    frontier = edges.filter("parent_id IS NULL").select("folder_id", F.array("folder_id").alias("path"))
    found, depth = frontier, 0
    while True:
        step = edges.join(frontier.select(F.col("folder_id").alias("parent_id"), "path"), "parent_id")
        frontier = checkpointed(step.select("folder_id", F.array_append("path", F.col("folder_id")).alias("path")))
        if frontier.isEmpty():
            break
        if most_depth is not None and depth >= most_depth:
            raise ValueError(f"folders lie deeper than {most_depth}")
        if not frontier.filter(F.size(F.array_distinct("path")) < F.size("path")).isEmpty():
            raise ValueError("a folder is its own ancestor")
        found, depth = found.unionByName(frontier), depth + 1
    return found.select("folder_id", (F.size("path") - 1).alias("depth"), "path")


def subtree(paths: DataFrame, folder_id: str) -> DataFrame:
    """A folder and all below it."""
    return paths.filter(F.array_contains("path", folder_id))


def scoped(entries: DataFrame, paths: DataFrame, folder_id: str, include_subfolders: bool = True) -> DataFrame:
    """Entries in a folder and, unless told otherwise, in those below it: a semi join before any ranking."""
    if not include_subfolders:
        return entries.filter(F.col("folder_id") == folder_id)
    return entries.join(subtree(paths, folder_id).select("folder_id"), "folder_id", "left_semi")


def breadcrumb(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Of each folder its ancestors and itself: ``folder_id``, ``depth`` from the root, ``ancestor_id``, ``name``."""
    steps = paths.select("folder_id", F.posexplode("path").alias("depth", "ancestor_id"))
    return steps.join(folders.select(F.col("folder_id").alias("ancestor_id"), "name"), "ancestor_id").select("folder_id", "depth", "ancestor_id", "name")


def move_verdicts(moves: DataFrame, paths: DataFrame) -> DataFrame:
    """``moves`` (folder_id, target_id) with ``verdict``: ``cycle`` if the target is the folder or lies below it, ``not_found`` or ``ok``."""
    targets = paths.select(F.col("folder_id").alias("target_id"), F.col("path").alias("_path"))
    cyclic = F.array_contains("_path", F.col("folder_id"))
    return moves.join(targets, "target_id", "left").select("folder_id", "target_id", F.when(F.col("_path").isNull(), "not_found").when(cyclic, "cycle").otherwise("ok").alias("verdict"))


def children(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Listing of all folders: ``parent_id``, ``kind`` (0 folder, 1 file), ``id``, ``name``; sort by kind, name and id to show one."""
    own = folders.filter("parent_id IS NOT NULL").select("parent_id", F.lit(0).alias("kind"), F.col("folder_id").cast("string").alias("id"), "name")
    return own.unionByName(files.select(F.col("folder_id").alias("parent_id"), F.lit(1).alias("kind"), F.col("file_id").cast("string").alias("id"), "name"))


def totals_before(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of the same group that come before by ``order``.

    Rows are cut into ranges of group and order, so a group of any size is many tasks; only its sums by range meet in one window.
    """
    ranged = rows.repartitionByRange(F.col(group).asc_nulls_first(), F.col(order))
    parts = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    before = lambda *by: Window.partitionBy(*by).orderBy(order if "_part" in by else "_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    past = sums.select(F.col("_part").alias("_of"), F.col(group).alias("_group"), F.coalesce(F.sum("_sum").over(before(group)), F.lit(0)).alias("_past"))
    inside = F.coalesce(F.sum(value).over(before("_part", group)), F.lit(0))
    joined = parts.withColumn("_inside", inside).join(past, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_inside") + F.col("_past")).drop("_part", "_inside", "_of", "_group", "_past")


def interval_labels(folders: DataFrame) -> DataFrame:
    """Of each folder that a root reaches: ``folder_id``, ``depth``, ``pre`` (its number in preorder, children by id) and ``size`` of its subtree.

    A folder lies in another's subtree if its ``pre`` is in ``[pre, pre + size)`` of the other. Sizes are summed up level by level,
    numbers handed down; each level is one grouping or join of its own folders, and ends in a checkpoint. No paths
    are kept, so rows don't grow with the depth. Folders on a cycle or below a missing parent have no label.
    """
    edges = folders.select("folder_id", "parent_id").distinct()
    level = checkpointed(edges.filter("parent_id IS NULL"))
    levels: list[DataFrame] = []
    while not level.isEmpty():
        levels.append(level)
        level = checkpointed(edges.join(level.select(F.col("folder_id").alias("parent_id")), "parent_id").select("folder_id", "parent_id"))
    if not levels:
        return folders.sparkSession.createDataFrame([], "folder_id string, depth int, pre long, size long")
    sizes: list[DataFrame] = []
    for depth in range(len(levels) - 1, -1, -1):
        own = levels[depth].withColumn("depth", F.lit(depth))
        if sizes:
            below = sizes[-1].groupBy(F.col("parent_id").alias("folder_id")).agg(F.sum("size").alias("_below"))
            own = own.join(below, "folder_id", "left")
            sizes.append(checkpointed(own.select("folder_id", "parent_id", "depth", (1 + F.coalesce("_below", F.lit(0))).cast("long").alias("size"))))
        else:
            sizes.append(own.withColumn("size", F.lit(1).cast("long")))
    whole = sizes[0]
    for more in sizes[1:]:
        whole = whole.unionByName(more)
    placed = checkpointed(totals_before(whole, "parent_id", "folder_id", "size", "before"))
    labelled = checkpointed(placed.filter("depth = 0").select("folder_id", "depth", F.col("before").alias("pre"), "size"))
    found = labelled
    for depth in range(1, len(levels)):
        up = labelled.select(F.col("folder_id").alias("parent_id"), F.col("pre").alias("_up"))
        own = placed.filter(F.col("depth") == depth).join(up, "parent_id")
        labelled = checkpointed(own.select("folder_id", "depth", (F.col("_up") + 1 + F.col("before")).alias("pre"), "size"))
        found = found.unionByName(labelled)
    return found


def inside(pre: Column, outer_pre: Column | int, outer_size: Column | int) -> Column:
    """Whether a label lies in another's interval."""
    return (pre >= outer_pre) & (pre < outer_pre + outer_size)


def interval_scope(labels: DataFrame, folder_id: str) -> DataFrame:
    """A folder and all below it: its own label is looked up, and the rest is a range filter."""
    own = labels.filter(F.col("folder_id") == folder_id).select("pre", "size").first()
    return labels.filter(inside(F.col("pre"), own.pre, own.size)) if own else labels.limit(0)


def interval_moves(moves: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``move_verdicts``: a move is a cycle if the target's number lies in the folder's interval."""
    target = labels.select(F.col("folder_id").alias("target_id"), F.col("pre").alias("_at"))
    moved = labels.select("folder_id", F.col("pre").alias("_pre"), F.col("size").alias("_size"))
    both = moves.join(target, "target_id", "left").join(moved, "folder_id", "left")
    cyclic = F.coalesce(inside(F.col("_at"), F.col("_pre"), F.col("_size")), F.lit(False))
    return both.select("folder_id", "target_id", F.when(F.col("_at").isNull(), "not_found").when(cyclic, "cycle").otherwise("ok").alias("verdict"))
