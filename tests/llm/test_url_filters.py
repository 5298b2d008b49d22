"""Verdicts against SQL and by hand."""

from datetime import date

from pyspark.sql import functions as F

from lodestar.llm.queries import ORACLES, QUERIES
from lodestar.llm.url_filters import list_intervals, url_filter, url_keys
from tests.llm.helpers import assert_equals_oracle


def test_oracle(spark):
    assert_equals_oracle(spark, QUERIES["op4_url_filters"], ORACLES["op4_url_filters"])
    assert_equals_oracle(spark, QUERIES["op4_url_filters"], ORACLES["op4_url_filters"], "/root/testdata/sf0.01")


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op4_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_keys(spark):
    urls = ["https://u@WWW.a.Example.com:80/en/x/?q#f", "a.com", "http://localhost/x", "", None, "http:///x"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_keys(F.col("u")).alias("k")).collect()]
    host = "www.a.example.com"
    assert got[0] == [host, "a.example.com", "example.com", f"{host}/en/", f"{host}/en/x/"]
    assert got[1] == ["a.com"] and got[2] == ["localhost", "localhost/x"] and got[3] == [] and not got[4] and got[5] == []


def test_time(spark):
    d = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame(
        [("a.com", d(2), "block"), ("a.com", d(2), "block"), ("a.com", d(5), "remove"), ("a.com", d(5), "allow"), ("a.com", d(9), "remove"), ("A.com/x/", d(4), "allow"), (None, d(1), "block"), ("a.com", None, "block")],
        "pattern string, effective date, action string",
    )
    assert list_intervals(entries).count() == 3
    rows = [(1, "http://a.com/y", d(1)), (2, "http://a.com/y", d(2)), (2, "http://a.com/y", d(2)), (3, "http://b.a.com/x/", d(4)), (4, "http://a.com/x/1", d(4)), (5, "http://a.com", d(5)), (6, "http://a.com", d(9)), (7, None, d(3)), (8, "http://a.com", None)]
    captures = spark.createDataFrame([(*r, 1) for r in rows], "id long, url string, fetched_at date, pattern int")
    got = sorted((r.id, r.blocked, r.pattern) for r in url_filter(captures, entries).filter("pattern is not null").collect())
    assert got == [(2, True, "a.com"), (2, True, "a.com"), (3, True, "a.com"), (4, False, "a.com/x/"), (5, False, "a.com")]
    assert url_filter(captures, entries).count() == len(rows)
    assert url_filter(captures, entries.limit(0)).filter("blocked").count() == 0
    assert url_filter(captures.limit(0), entries).count() == 0


def test_paths_keep_their_case(spark):
    d = date(2024, 1, 1)
    entries = spark.createDataFrame([("a.com/News/", d, "block"), ("HTTP://u@B.com:80/x?q#f", d, "block"), ("/x/", d, "block"), ("", d, "block")], "pattern string, effective date, action string")
    urls = ["http://A.com/News/x", "http://a.com/news/x", "https://b.com:8080/x?y", "https://b.com/X"]
    captures = spark.createDataFrame([(i, u, d) for i, u in enumerate(urls)], "id int, url string, fetched_at date")
    assert [r.id for r in url_filter(captures, entries).filter("blocked").orderBy("id").collect()] == [0, 2]


def test_dot_before_a_port_and_clashing_names(spark):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    entries = spark.createDataFrame([("a.com", day, "block")], "pattern string, effective timestamp, action string")
    rows = [("http://a.com.:80/x", day, 1), ("http://a.com:/x", day, 2), ("http://b.com", day, 3), (None, day, 4)]
    captures = spark.createDataFrame(rows, "url string, fetched_at timestamp, _url int").selectExpr("*", "_url AS _at", "_url AS _key", "_url AS _best", "_url AS valid_to", "_url AS action", "_url AS `x.y`")
    got = url_filter(captures, entries)
    assert got.columns == [*captures.columns, "blocked", "pattern", "valid_from"]
    assert sorted((r["_url"], r["_at"], r["_best"], r["x.y"], r.blocked) for r in got.collect()) == [(1, 1, 1, 1, True), (2, 2, 2, 2, True), (3, 3, 3, 3, False), (4, 4, 4, 4, False)]
