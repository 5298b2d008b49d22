"""Two-pass external shuffle into shards of equal row counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import free_names, row_hash, sized

#: Bytes that a row counts beside its text, so that many short rows fill a bucket too.
ROW_BYTES = 128
#: Tasks of the second pass at most, whatever the input: each has one row in the table of offsets, which is broadcast.
MOST_TASKS = 500_000


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = 32 << 20, most_buckets: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` in random order, with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Pass 1 scatters rows by a seeded hash of id and text into buckets of about ``bucket_bytes``. Pass 2
    sorts a task's rows by bucket and by a hash of whole rows, so that a rerun on another executor agrees, and
    permutes one bucket after the other by a seeded Fisher-Yates shuffle. A task has up to ``most_buckets``
    neighbouring buckets, fewer while the table has few, and more only beyond MOST_TASKS full tasks; the
    order doesn't depend on that. A row's place in the whole order is its task's offset plus its place there, and
    shards are equal parts of the order, their counts at most one apart. So a task's rows lie in one
    shard, or few, in the order of their slots. Rows that are equal in id and text share a bucket and lie
    near each other; a bucket of over four times its size is permuted in parts, so memory is bounded for them too.
    Nulls are ordinary values. Any columns named ``shard`` or ``slot`` are replaced.
    """
    kept = docs.drop("shard", "slot")
    bucket, task, order, place, offset = free_names(kept, "_bucket", "_task", "_order", "_place", "_offset")
    rows, size = kept.agg(F.count("*"), F.sum(sized(text) + ROW_BYTES)).first()
    n = max(1, -(-(size or 0) // bucket_bytes))
    parallel = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = max(1, min(most_buckets, n // parallel), -(-n // MOST_TASKS))
    tasks = -(-n // many)
    number = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column), F.col(text)), F.lit(n))
    placed = kept.withColumns({bucket: number, order: row_hash(kept, seed)}).withColumn(task, F.floor(F.col(bucket) / many).cast("int"))
    names = [*kept.columns, task, place]
    schema = T.StructType([*kept.schema.fields, T.StructField(task, T.IntegerType()), T.StructField(place, T.LongType())])
    most = 4 * bucket_bytes

    def permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, part, weight, first = [], None, 0, 0, 0

        def shuffled() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            turns = np.random.default_rng([seed, at, part]).permutation(whole.num_rows)
            for start in range(0, len(turns), 1000):
                some = whole.take(pa.array(turns[start : start + 1000])).drop_columns([bucket, order])
                some = some.append_column(place, pa.array(np.arange(first + start, first + start + some.num_rows)))
                yield from some.select(names).combine_chunks().to_batches()

        for batch in batches:
            numbers = batch.column(bucket).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and (numbers[i] != at or weight > most):
                    yield from shuffled()
                    first += sum(b.num_rows for b in held)
                    part, held, weight = (part + 1 if numbers[i] == at else 0), [], 0
                at = int(numbers[i])
                held.append(batch.slice(i, j - i))
                weight += held[-1].nbytes
        if held:
            yield from shuffled()

    parts = placed.repartitionById(tasks, task).sortWithinPartitions(bucket, order)
    shuffled = parts.mapInArrow(permuted, schema)
    counts = kept.select(F.floor(number / many).cast("int").alias(task)).groupBy(task).agg(F.count("*").alias("rows"))
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(task, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(offset))
    # one short row per task, MOST_TASKS at most
    whole = F.col(offset) + F.col(place)
    less, more = divmod(rows, shards)
    edge = more * (less + 1)  # the first ``more`` shards have one row more
    long, rest = F.expr(f"`{offset}` + `{place}`"), F.greatest(F.lit(less), F.lit(1))
    shard = F.when(whole < edge, F.floor(long / (less + 1))).otherwise(more + F.floor((long - edge) / rest))
    slot = F.when(whole < edge, F.pmod(long, F.lit(less + 1))).otherwise(F.pmod(long - edge, rest))
    joined = shuffled.join(F.broadcast(offsets), task)
    return joined.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).select(*[F.col(f"`{c}`") for c in kept.columns], "shard", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes shards as folders ``shard=k`` of Parquet.

    A task's rows come in the order of their slots and lie in one shard as a rule, so it
    writes one large file; a shard's files by name, and rows as they stand in them, are in the order of ``slot``.
    """
    shuffled.write.partitionBy("shard").parquet(path)
