"""Approximate nearest neighbours: vectors in k-means cells, several cells probed, exact scores inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.checkpoints import is_file
from lodestar.operators.search import cosine_topk

#: Vectors that the cells are fitted on, about; every vector is stored.
SAMPLE_ROWS = 200_000
#: Vectors of the table that are asked for to see how many cells a query needs.
ASKED = 64


def probes_for(stored: DataFrame, centres: np.ndarray, recall: float, key: str, vector: str, k: int = 40, asked: int = ASKED) -> int:
    """The least number of cells, nearest to the query first, that holds ``recall`` of the ``k`` nearest vectors of ``asked`` of the vectors.

    Each task keeps the best ``k`` of its rows for each of these queries.
    """
    queries = np.array([list(r[0]) for r in stored.orderBy(F.xxhash64(key)).select(vector).limit(asked).collect()], float)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            new = queries @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T
            score, cell = np.concatenate([score, new], axis=1), np.concatenate([cell, np.broadcast_to(batch.column(1).to_numpy(), new.shape)], axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        if score.shape[1]:
            number = np.repeat(np.arange(len(queries)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(score.ravel()), pa.array(cell.ravel().astype(np.int32))], names=["query", "score", "cell"])

    found = stored.select(vector, "cell").mapInArrow(best, "query int, score double, cell int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))
    near = found.withColumn("place", place).filter(F.col("place") <= k).groupBy("query", "cell").count().collect()
    order = np.argsort(-(queries @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)).T), axis=1, kind="stable")
    seat = np.argsort(order, axis=1)
    at = np.repeat([seat[r["query"], r["cell"]] for r in near], [r["count"] for r in near])
    return int(np.searchsorted(np.cumsum(np.bincount(at)) / len(at), recall - 1e-12) + 1)


class VectorCells:
    """A table of vectors at ``at``, partitioned by ``cell``, and the table of the cells' centres, which is bounded by ``cells``."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def exists(self) -> bool:
        """Whether a build has come to its end; the table written last has its mark then."""
        return is_file(self.spark, f"{self.at}/centres/_SUCCESS")

    def build(self, vectors: DataFrame, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 42, sample_rows: int = SAMPLE_ROWS, recall: float = 0.95) -> None:
        """Fits ``cells`` (by default about the square root of the rows, 4096 at most) by cosine, and writes every vector into its own.

        Vectors without length, which no cosine reaches, are left out. How many cells a query has to probe for ``recall`` is measured on
        a few vectors of the table and stored.
        """
        doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
        unit = vectors.select(F.col(key), F.col(vector), doubles.alias("_d")).filter(F.exists("_d", lambda x: x != 0)).withColumn("features", array_to_vector("_d")).drop("_d")
        rows = unit.count()
        cells = cells or int(min(4096, max(1, round(rows**0.5))))
        sample = unit if rows <= sample_rows else unit.sample(False, sample_rows / rows, seed)
        if not rows:
            raise ValueError("there are no vectors to place in cells")
        model = KMeans(k=max(2, cells), seed=seed, maxIter=15, distanceMeasure="cosine").fit(sample)
        placed = model.transform(unit).select(key, vector, F.col("prediction").alias("cell"))
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.at}/vectors")
        stored = self.spark.read.parquet(f"{self.at}/vectors")
        middle = np.array(model.clusterCenters())
        self.spark.createDataFrame([(probes_for(stored, middle, recall, key, vector),)], "probes int").write.mode("overwrite").parquet(f"{self.at}/probes")
        centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(centres, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{self.at}/centres")

    def probed(self, query: list[float], probes: int) -> list[int]:
        """The cells whose centres are nearest to the query by cosine."""
        rows = self.spark.read.parquet(f"{self.at}/centres").orderBy("cell").collect()
        centres = np.array([r.centre for r in rows])
        score = centres @ np.asarray(query, float) / np.maximum(np.linalg.norm(centres, axis=1), 1e-300)
        return [rows[i].cell for i in np.argsort(-score, kind="stable")[:probes]]

    def topk(self, query: list[float], k: int = 40, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """As ``cosine_topk``, over the vectors of the probed cells (as many as the build found to be needed): other cells' files aren't read. With all cells probed it is exact."""
        stored = self.spark.read.parquet(f"{self.at}/vectors")
        probes = probes or self.spark.read.parquet(f"{self.at}/probes").first().probes
        return cosine_topk(stored.filter(F.col("cell").isin(self.probed(query, probes))), query, k, key, vector)
