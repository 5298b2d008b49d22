"""A trigram index of names: few names are scored for a query.

A similarity over ``least`` of sets of a and q trigrams means that they share more than ``least * (a + q) / (1 + least)``; and a
name that holds the query in itself shares the trigrams inside the query's words. So a name's number of shared
trigrams and its size decide whether it can be a hit, before it is read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.checkpoints import is_file
from lodestar.functions.vectors import trigrams
from lodestar.operators.search import NAME_LEAST, SearchInput, name_search

#: Names of a block: one row of postings covers one block.
BLOCK_BITS = 12


def inner_trigrams(query: str) -> list[str]:
    """Trigrams that every name has which holds the query, wildcards (``%``, ``_``) included.

    Inside its runs of letters and digits those without padding; where a run meets another character of the
    query, a word of the name begins or ends, and its padded trigrams are known too.
    """
    found: list[str] = []
    for piece in re.split(r"[%_\\]", query.lower()):
        for run in re.finditer(r"[^\W_]+", piece):
            begins, ends = run.start() > 0, run.end() < len(piece)
            padded = ("  " if begins else "") + run.group() + (" " if ends else "")
            found += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return list(dict.fromkeys(found))


class NameIndex:
    """Postings of trigrams at ``at``: (trigram, block, names as ``name_no`` and number of trigrams), and the entries by ``name_no``."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def exists(self) -> bool:
        """Whether a build has come to its end; the table written last has its mark then."""
        return is_file(self.spark, f"{self.at}/trigrams/_SUCCESS")

    def build(self, entries: DataFrame) -> None:
        entries.withColumn("name_no", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.at}/entries")
        rows = self.spark.read.parquet(f"{self.at}/entries").select("name_no", trigrams(F.col("name")).alias("t"))
        each = rows.select("name_no", F.size("t").alias("n"), F.explode("t").alias("trigram"))
        block = F.shiftright("name_no", BLOCK_BITS).alias("block")
        posted = each.groupBy("trigram", block).agg(F.array_sort(F.collect_list(F.struct("name_no", "n"))).alias("names"))
        posted.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block").write.mode("overwrite").parquet(f"{self.at}/trigrams")

    def candidates(self, query: str, least: float = NAME_LEAST) -> DataFrame:
        """``name_no`` of the names that may be hits: those whose count of shared trigrams allows it."""
        q = self.spark.range(1).select(trigrams(F.lit(query.lower())).alias("t")).first().t
        inner = inner_trigrams(query)
        posted = self.spark.read.parquet(f"{self.at}/trigrams").filter(F.col("trigram").isin(list({*q, *inner}) or [""]))
        each = posted.select("trigram", F.explode("names").alias("x")).select("trigram", "x.name_no", "x.n")
        mine = each.groupBy("name_no").agg(F.max("n").alias("n"), F.count_if(F.col("trigram").isin(q or [""])).alias("shared"), F.count_if(F.col("trigram").isin(inner or [""])).alias("inner"))
        similar = (F.col("shared") > 0) & (F.col("shared") * (1 + least) > least * (F.col("n") + len(q)) - 1e-9)
        holds = F.col("inner") >= len(inner) if inner else F.lit(False)
        return mine.filter(similar | holds).select("name_no")

    def search(self, wanted: SearchInput) -> DataFrame:
        """The rows of ``name_search``. A query whose places inside a name give no trigram (one or two letters) scores every name, as only that is exact."""
        wanted = wanted.checked()
        entries = self.spark.read.parquet(f"{self.at}/entries")
        if not inner_trigrams(wanted.query):
            return name_search(entries.drop("name_no"), wanted)
        return name_search(entries.join(self.candidates(wanted.query), "name_no", "left_semi").drop("name_no"), wanted)
