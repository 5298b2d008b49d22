"""Embeddings from a provider in batches, and the outcome of every document from reading to storing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.runs import changes, whole_runs
from lodestar.functions.vectors import DIMENSION, query_vector

#: Texts of one document that a call of the provider takes.
BATCH_TEXTS = 10


class Provider(Protocol):
    """What a provider has to offer; it is sent to the tasks, so it must pickle. A call fails by raising."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """The offline provider: hashed words, no network."""

    model = "hashed-words"

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [query_vector(t, self.dimension) for t in texts]


def embedded(chunks: DataFrame, provider: Provider, dimension: int = DIMENSION, batch_texts: int = BATCH_TEXTS) -> DataFrame:
    """Chunks (``object_id``, ``ordinal``, ``content``) with ``embedding`` and ``error_code``.

    A document's chunks go to the provider in order, ``batch_texts`` a call, whatever Arrow batches they come in. A failed call, or one that
    gives another number of vectors, marks its chunks ``ai.embedding_failed``; a vector of another dimension its chunk ``ai.persistence_failed``. The
    rest of the task goes on. A task reads one document after the other, of which it holds one Arrow batch and a document.
    """
    rows = chunks.select("object_id", "ordinal", "content").repartition("object_id").sortWithinPartitions("object_id", "ordinal")
    schema = f"object_id {chunks.schema['object_id'].dataType.simpleString()}, ordinal int, content string, embedding array<float>, error_code string"

    def called(texts: list[str]) -> tuple[list, list]:
        try:
            found = provider.embed(texts)
        except Exception:  # noqa: BLE001  whatever a provider raises is that call's outcome
            found = []
        if len(found) != len(texts):
            return [None] * len(texts), ["ai.embedding_failed"] * len(texts)
        fits = [len(v) == dimension for v in found]
        return [v if ok else None for v, ok in zip(found, fits, strict=True)], [None if ok else "ai.persistence_failed" for ok in fits]

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ["object_id"]):
            starts = np.flatnonzero(changes(part, ["object_id"]))
            ends = np.append(starts[1:], part.num_rows)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                for i in range(a, b, batch_texts):
                    some = part.slice(i, min(batch_texts, b - i))
                    vectors, codes = called(some.column("content").to_pylist())
                    arrays = [some.column(c).combine_chunks() for c in ("object_id", "ordinal", "content")]
                    arrays[1] = arrays[1].cast(pa.int32())
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(vectors, pa.list_(pa.float32())), pa.array(codes, pa.string())], names=["object_id", "ordinal", "content", "embedding", "error_code"])

    return rows.mapInArrow(batched, schema)


def embedding_outcomes(vectors: DataFrame) -> DataFrame:
    """Of each document of ``embedded``: ``indexed``, or ``failed`` with the code that comes first by chunk."""
    first = F.min_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("ordinal")))
    found = vectors.groupBy("object_id").agg(first.alias("error_code"))
    return found.select("object_id", F.when(F.col("error_code").isNull(), "indexed").otherwise("failed").alias("outcome"), "error_code")


def document_outcomes(*stages: DataFrame) -> DataFrame:
    """One outcome for each object: that of the first stage that ended it, else of the last one that saw it.

    Stages (``object_id``, ``outcome``, ``error_code``) come in order, such as those before reading (``index_outcomes``), after
    reading (``read_outcomes``), after extraction and after embedding. Outcomes ``process`` and ``indexed`` let an object go on.
    """
    numbered = [s.select("object_id", "outcome", "error_code", F.lit(k).alias("_stage")) for k, s in enumerate(stages)]
    every = reduce(DataFrame.unionByName, numbered)
    ended = ~F.col("outcome").isin("process", "indexed")
    rank: Column = F.when(ended, F.col("_stage")).otherwise(1000 - F.col("_stage"))
    best = every.groupBy("object_id").agg(F.min_by(F.struct("outcome", "error_code"), rank).alias("o"))
    return best.select("object_id", "o.outcome", "o.error_code")


def read_outcomes(files: DataFrame, read: DataFrame) -> DataFrame:
    """Of each of ``files`` (object_id, size_bytes) what reading gave (``read``: object_id, size_bytes of what came): ``process``, or ``failed`` if nothing or another number of bytes came."""
    got = read.select("object_id", F.col("size_bytes").alias("_got"))
    rows = files.select("object_id", "size_bytes").join(got, "object_id", "left")
    whole = F.coalesce(F.col("_got") == F.col("size_bytes"), F.lit(False))
    return rows.select("object_id", F.when(whole, "process").otherwise("failed").alias("outcome"), F.when(~whole, "ai.object_read_failed").alias("error_code"))
