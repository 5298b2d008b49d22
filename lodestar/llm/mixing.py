"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies, target / size of
the source. The fractions are rounded in pairs: mass moves between two documents, in words, so
that the source's expected words never change, in a random direction that keeps each
document's expectation, until one of the two is integral. Groups of documents leave at
most one fraction each; these residuals are grouped and rounded again, level by level, until
a source has one left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import free_names, row_hash, word_count, written

#: Weights by the order of sources, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Of each source: ``source_size``, ``n``, ``rank`` and ``target``.

    ``sized`` has a column ``size``. Targets share the whole size by weight; one over ``most``
    times its source's size stops there, and the rest is shared again. Null sorts last. The
    capped sources are found by sums over the source table, round by round. Ranks are counted in ranges of
    sources, so there may be millions of them.
    """
    sources = sized.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranged = written(sources.repartitionByRange(F.col(source).asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "source-ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(source).asc_nulls_last())) - 1
    numbered = ranged.withColumn("_inside", inside).join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    ranked = written(numbered.withColumn("rank", (F.col("_before") + F.col("_inside")).cast("int")).drop("_range", "_inside", "_of", "_before"), "sources")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("rank"), F.lit(len(weights)))]
    cap = most * F.col("source_size").cast("double")
    level, capped = 0.0, F.lit(False)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        at = ranked.agg(F.sum(F.when(~capped, weight)).alias("w"), F.sum(F.when(capped, cap)).alias("c")).first()
        if not at.w:
            break
        found = (total - (at.c or 0.0)) / at.w
        if found <= level:
            break
        level = found
        capped = F.lit(level) * weight > cap
    return ranked.withColumn("target", F.least(F.lit(level) * weight, cap))


def pivotal(x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds fractions of documents of positive sizes in order; at most one stays fractional."""
    x, tiny = x.copy(), 1e-9
    draws = rng.random(len(x))
    held = -1
    for j in range(len(x)):
        if x[j] <= tiny or x[j] >= 1 - tiny:
            x[j] = round(x[j])
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        up = min(a * (1 - x[held]), b * x[j])
        down = min(a * x[held], b * (1 - x[j]))
        move = up if draws[j] * (up + down) < down else -down
        x[held] += move / a
        x[j] -= move / b
        for k in (held, j):
            if x[k] <= tiny or x[k] >= 1 - tiny:
                x[k] = round(x[k])
        held = held if 0 < x[held] < 1 else j if 0 < x[j] < 1 else -1
    return x


def mix_copies(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, group_rows: int = 10_000, fan: int = 500, most: int = 3, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: id, source, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies x size).

    Groups hold about ``group_rows`` documents of one source by a hash of the id, so a hot
    source is many groups; ``fan`` residuals meet in a group of the next level. Rows that are equal in all
    that counts are one row with a number first, cut into runs of a tenth of a group, so a hot row is in many groups too.
    Larger documents are rounded first, so what is left at the end is small as a rule. Draws are
    seeded by source, group and level, and rows are in a fixed order, so reruns agree.
    Null texts and blank texts have size 0 and take nothing. ``keep``: more columns by name.
    """
    names = ["_id", "_source", *(keep or {})]
    columns = [F.col(id_column).alias("_id"), F.col(source).alias("_source"), *[c.alias(n) for n, c in (keep or {}).items()]]
    each = docs.select(*columns, word_count(text).alias("size"), F.xxhash64(F.lit(seed), id_column, text).alias("_h"))
    base = written(each.groupBy(*names, "size", "_h").agg(F.count("*").alias("_m")), "sizes")
    of_source = base.groupBy("_source").agg(F.sum(F.col("size") * F.col("_m")).alias("size"), F.sum("_m").alias("n"))
    targets = source_targets(of_source, "_source", most=most).withColumnRenamed("_source", "_of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / group_rows))
    run = max(1, group_rows // 10)
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / run)))
    rows = (
        base.join(targets, base["_source"].eqNullSafe(targets["_of"]))
        .drop("_of")
        .withColumn("_run", runs)
        .withColumn("_m", F.least(F.lit(run).cast("long"), F.col("_m") - F.col("_run") * run).cast("int"))
        .withColumn("_group", F.pmod(F.when(F.col("_run") == 0, F.shiftrightunsigned("_h", 20)).otherwise(F.xxhash64("_h", "_run")), groups).cast("long"))
        .withColumn("_whole", F.floor(ratio + 1e-9))
        .withColumn("_x", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - F.col("_whole"))).otherwise(0.0))
        .drop("_run")
    )
    most_groups = targets.agg(F.max(groups)).first()[0] or 1
    schema = rows.schema

    def rounded(level: int):
        def step(part: pd.DataFrame) -> pd.DataFrame:
            part = part.loc[part.index.repeat(part["_m"])].assign(_m=np.int32(1))
            part = part.sort_values(["size", "_h"], ascending=[False, True], kind="stable")
            rng = np.random.default_rng([seed, level, int(part["rank"].iloc[0]), int(part["_group"].iloc[0])])
            part["_x"] = pivotal(part["_x"].to_numpy(), part["size"].to_numpy(), rng)
            return part

        return step

    done, level = [], 0
    while True:
        part = written(rows.groupBy("rank", "_group").applyInPandas(rounded(level), schema), "rounded")
        split = (F.col("_x") > 0) & (F.col("_x") < 1)
        if most_groups <= 1:
            done.append(part)
            break
        done.append(part.filter(~split))
        rows = part.filter(split).withColumn("_group", F.floor(F.col("_group") / fan))
        most_groups, level = -(-most_groups // fan), level + 1
    merged = done[0]
    for part in done[1:]:
        merged = merged.unionByName(part)
    last = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "rank"), F.lit(1 << 30)) / float(1 << 30) < F.col("_x")
    copies = (F.col("_whole") + F.when((F.col("_x") > 0) & (F.col("_x") < 1), last.cast("long")).otherwise(F.col("_x").cast("long"))).cast("long")
    out = merged.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("_id").alias(id_column), F.col("_source").alias(source), "size", "source_size", "target", "copies", "taken", *(keep or {}))


def mixed(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all, up to three times).

    Blank texts have no words to weigh and are left out when their source gives no whole copy. Rows find their copies by the
    SHA-256 of id, source and text, and rows equal in these by a hash of the whole row;
    those equal in all columns share their copies. Any column names and types will do.
    """
    key, rest, turn, copy = free_names(docs, "_key", "_rest", "_turn", "_copy")
    parts = [F.coalesce(F.to_json(F.struct(F.col(id_column).alias("i"), F.col(source).alias("s"))), F.lit("")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text), F.lit(""))]
    digest, whole = F.unhex(F.sha2(F.concat(*parts), 256)), row_hash(docs, seed)
    copies = mix_copies(docs, id_column, source, text, seed, keep={"_digest": digest, "_row": whole})
    times = copies.groupBy("_digest", "_row").agg(F.sum("copies").cast("int").alias("_times")).filter("_times > 0")
    # one of equal rows stays before the join: a task sends one of each
    once = F.row_number().over(Window.partitionBy(key, rest).orderBy(rest))
    single = docs.withColumns({key: digest, rest: whole}).withColumn(turn, once).filter(F.col(turn) == 1)
    keyed = single.join(times, (F.col(key) == F.col("_digest")) & (F.col(rest) == F.col("_row")))
    return keyed.withColumn(copy, F.explode(F.sequence(F.lit(1), times["_times"]))).select(*[docs[f"`{c}`"] for c in docs.columns])
