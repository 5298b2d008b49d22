"""Metrics and host verdicts against SQL and brute force."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from lodestar.llm import quality
from lodestar.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import assert_equals_oracle


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["a", "b", " ", " ", "\n", "#", "é", " ", "a b a b a b\n"]), max_size=40).map("".join), max_size=6))
def test_metrics(texts):
    got = [x.tolist() for x in quality._metrics(pa.array(texts, pa.string()), 5)]
    assert [list(x) for x in zip(*got, strict=True)] == [brute(t) for t in texts]


def test_oracle(spark):
    assert_equals_oracle(spark, QUERIES["op6_quality_rules"], ORACLES["op6_quality_rules"])


def test_hosts(spark):
    good = "the quick brown fox jumps over the lazy dog again today"
    rows = [(i, "good", good) for i in range(60)] + [(100 + i, "bad", "x") for i in range(50)] + [(200, "bad", good), (201, None, good), (202, None, None), (203, "one", ""), (203, "one", "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, source string, text string, kept string")
    got = quality.quality_verdicts(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(docs.collect())
    assert rows[0].kept and not rows[100].kept and rows[200].base_failed is False and not rows[200].kept
    assert rows[202].n_words == 0 and rows[202].base_failed and rows[201].kept is (rows[201].rate_base <= 0.5)
    assert 0 < rows[203].rate_base < 1  # shrunk: two failures of two
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_soft_rules_follow_the_host(spark):
    plain = "the quick brown fox jumps over the lazy dog again today"
    signs = plain + " # # # #"
    rows = [(i, "rare", signs if i == 0 else plain) for i in range(200)] + [(1000 + i, "often", signs if i < 40 else plain) for i in range(100)] + [(2000, "tiny", signs), (2001, "tiny", plain)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not got[1000].base_failed and not got[1000].kept and got[1050].kept
    assert got[0].soft_symbols and got[0].kept  # one of two hundred is forgiven
    assert 0.05 < got[2000].rate_symbols < 0.5 and not got[2000].kept  # a host of two stands near the mean


def test_query_uses_the_verdicts(spark):
    got = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01")
    assert got.filter("base_failed AND kept").count() == 0 < got.filter("NOT base_failed AND NOT kept").count() < got.filter("kept").count()
