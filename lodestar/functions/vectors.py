"""Trigram similarity, hashed embeddings and cosines as column expressions; none of them shuffles."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import words

DIMENSION = 1024


def trigrams(text: Column) -> Column:
    """Distinct three-character parts of the lower-case words, each padded by two blanks before and one after."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(parts, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Common trigrams over all trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    either = F.size(F.array_union(x, y))
    return F.when(either > 0, F.size(F.array_intersect(x, y)) / either).otherwise(0.0)


def hashed_buckets(text: Column, dimension: int = DIMENSION) -> Column:
    """Signed buckets of the lower-case words of a text, four a word from its SHA-256: ``2 * bucket + (1 if negative)``."""
    number = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    own = lambda h: F.array(*[2 * (number(h, 4 * o + 1, 4) % dimension) + number(h, 33 + 2 * o, 2) % 2 for o in range(4)])
    hashes = F.transform(words(F.lower(text)), lambda w: F.sha2(w, 256))
    return F.flatten(F.transform(hashes, own))


class WordBuckets:
    """The signed buckets of :func:`hashed_buckets` for Arrow arrays of words; a task hashes a word once while it knows it."""

    MOST = 200_000

    def __init__(self, dimension: int = DIMENSION):
        self.dimension, self.known = dimension, {}

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs, four of each a word."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.MOST:
            self.known.clear()
        for word in distinct:
            if word not in self.known:
                self.known[word] = sha256(word.encode()).digest()
        digest = np.frombuffer(b"".join(self.known[w] for w in distinct), np.uint8).reshape(-1, 32).astype(np.int64)
        places, signs = (digest[:, 0:8:2] * 256 + digest[:, 1:8:2]) % self.dimension, 1 - 2 * (digest[:, 16:20] & 1)
        at = coded.indices.to_numpy()
        return places[at], signs[at]


def query_vector(text: str, dimension: int = DIMENSION) -> list[float]:
    """The unit vector of one query, on the driver; the same rule as :func:`hashed_buckets`."""
    vector = [0.0] * dimension
    for word in text.lower().split():
        digest = sha256(word.encode()).digest()
        for o in range(4):
            vector[(digest[2 * o] << 8 | digest[2 * o + 1]) % dimension] += -1.0 if digest[16 + o] & 1 else 1.0
    norm = sum(x * x for x in vector) ** 0.5
    return [x / norm for x in vector] if norm else vector


def bucket_norm(buckets: Column) -> Column:
    """Length of the vector that signed buckets sum up to: runs of equal buckets in their sorted array."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, code: Column) -> Column:
        bucket, sign = F.floor(code / 2).cast("int"), (1 - 2 * (code % 2)).cast("long")
        same = acc.at == bucket
        return F.struct(
            F.when(same, acc.total).otherwise(acc.total + acc.sum * acc.sum).alias("total"),
            bucket.alias("at"),
            F.when(same, acc.sum + sign).otherwise(sign).alias("sum"),
        )

    return F.sqrt(F.aggregate(F.array_sort(buckets), start, step, lambda acc: (acc.total + acc.sum * acc.sum).cast("double")))


def bucket_dot(buckets: Column, query: list[float]) -> Column:
    """Inner product of the vector that signed buckets sum up to and a dense one."""
    weights = vector_literal(query)
    return F.aggregate(buckets, F.lit(0.0), lambda acc, code: acc + (1 - 2 * (code % 2)) * F.get(weights, F.floor(code / 2).cast("int")))


def vector_literal(values: list[float]) -> Column:
    """A constant array of doubles, parsed at once."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")") if len(values) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; null if one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
