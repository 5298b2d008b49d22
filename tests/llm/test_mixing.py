"""Mixing: targets against brute force, sums, expectations and reruns."""

import numpy as np
import pytest

from lodestar.llm.mixing import mix_copies, mixed, pivotal
from lodestar.llm.queries import QUERIES
from tests.llm.helpers import SMALL


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s: 3.0 * sizes[s] for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= over


def test_query(spark):
    rows = QUERIES["op10_mixing"](spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes = {}
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    targets, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    largest = dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(docs[r.doc_id].text.split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1e-6
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op10_mixing"](spark, SMALL).collect()))


def test_levels_and_odd_rows(spark):
    rows = [(i, "b" if i % 3 else "a", "w " * (i % 17 + 1)) for i in range(900)] + [(1000, None, "x y"), (1001, None, None), (1002, "c", ""), (1003, "big", "v " * 3000), (5, "b", "w " * 6), (5, "b", "w " * 6)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int")
    got = mix_copies(docs, group_rows=20, fan=4)
    found = got.collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    for s, t in targets.items():
        mine = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in mine) - t) <= max(r.size for r in mine) + 1e-6
        assert all(r.target == pytest.approx(t) for r in mine)
    again = mix_copies(docs.repartition(3), group_rows=20, fan=4).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    whole = mixed(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in mix_copies(docs).collect())
    assert mix_copies(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0


def test_pivotal_keeps_expectation():
    x, size = np.array([0.2, 0.7, 0.5, 0.9, 0.4]), np.array([10.0, 3.0, 7.0, 1.0, 4.0])
    mean = np.zeros(5)
    for k in range(4000):
        out = pivotal(x, size, np.random.default_rng(k))
        assert ((out > 0) & (out < 1)).sum() <= 1 and out @ size == pytest.approx(x @ size)
        mean += out / 4000
    assert np.abs(mean - x).max() < 0.03


def test_hot_rows_and_odd_columns(spark):
    rows = [(7, "hot", "a b c", 1)] * 400 + [(7, "hot", "a b c", 2)] * 3 + [(i, "cold", "w " * 5, i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _key long").selectExpr("*", "map('k', _key) AS m", "1 AS _copy", "2 AS rank")
    got = mix_copies(docs, group_rows=20, fan=4)
    assert got.count() == len(rows)
    targets = brute_targets({"hot": 403 * 3, "cold": 500})
    for s, t in targets.items():
        assert abs(got.filter(f"source = '{s}'").agg({"taken": "sum"}).first()[0] - t) <= 5
    whole = mixed(docs)
    assert whole.columns == docs.columns
    assert {(r.doc_id, r._key, r.m["k"]) for r in whole.collect()} <= {(r[0], r[3], r[3]) for r in rows}
    assert whole.count() == mix_copies(docs).agg({"copies": "sum"}).first()[0]


def test_ranks_of_many_sources(spark):
    from lodestar.llm.mixing import source_targets

    sized = spark.range(300).selectExpr("concat('s', id) AS source", "id + 1 AS size").unionByName(spark.createDataFrame([(None, 5)], "source string, size long"))
    got = sorted(source_targets(sized).collect(), key=lambda r: r.rank)
    assert [r.source for r in got] == sorted(f"s{i}" for i in range(300)) + [None] and [r.rank for r in got] == list(range(301))
    want = brute_targets({r.source: r.source_size for r in got})
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
