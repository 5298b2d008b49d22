"""The external shuffle: a permutation, gapless slots, equal counts, reruns that agree."""

from collections import Counter

from lodestar.llm.queries import QUERIES
from lodestar.llm.sharding import external_shuffle, write_shards
from tests.llm.helpers import SMALL


def laws(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[k] for k in range(shards)) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))


def test_query(spark):
    got = QUERIES["op8_sharding"](spark, SMALL)
    rows = got.collect()
    laws(rows, 8)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "octet_length(text) + 1 AS size", "crc32(text) AS c").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(map(tuple, docs))
    again = QUERIES["op8_sharding"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_buckets_and_odd_rows(spark):
    rows = [(i % 50, "text" * (i % 7), i) for i in range(300)] + [(None, None, 1), (None, "", 2), (7, "x" * 100_000, 3), (7, "x" * 100_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    small = external_shuffle(docs, shards=3, bucket_bytes=2000)
    assert small.columns == ["doc_id", "text", "shard", "slot"]
    got = small.collect()
    laws(got, 3)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, got)) == sorted(map(key, rows))
    other = external_shuffle(docs.repartition(5), shards=3, bucket_bytes=2000).collect()
    assert Counter((*key(r), r.shard, r.slot) for r in got) == Counter((*key(r), r.shard, r.slot) for r in other)
    single = external_shuffle(docs, shards=3, bucket_bytes=2000, most_buckets=1).collect()
    assert Counter((*key(r), r.shard, r.slot) for r in got) == Counter((*key(r), r.shard, r.slot) for r in single)
    assert external_shuffle(docs.limit(0)).count() == 0
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order, key=str)


def test_clashing_names_and_short_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'' AS text", "id AS _bucket", "id AS _offset", "id AS _place", "map('a', id) AS m")
    got = external_shuffle(docs, bucket_bytes=8 << 10)
    assert got.columns == [*docs.columns, "shard", "slot"]
    rows = got.collect()
    laws(rows, 8)
    assert all(r.doc_id == r._bucket == r._offset == r._place == r.m["a"] for r in rows)
    assert got.rdd.getNumPartitions() > 4  # empty texts fill buckets too
    few = external_shuffle(docs.limit(3))
    assert sorted((r.shard, r.slot) for r in few.collect()) == [(0, 0), (1, 0), (2, 0)]


def test_files_in_slot_order(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    write_shards(external_shuffle(docs, shards=4, bucket_bytes=32 << 10), str(tmp_path / "out"))
    import pyarrow.parquet as pq

    files = 0
    for k in range(4):
        names = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        files += len(names)
        slots = [s for f in names for s in pq.read_table(f, partitioning=None).column("slot").to_pylist()]
        assert slots == list(range(500))
    buckets = -(-2000 * 228 // (32 << 10))
    assert files <= buckets + 4
