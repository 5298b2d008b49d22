"""The manifest against a plain recursion, for many shapes of trees, odd rows and another fan."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestar.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, at, fan):
    """The root, and what stands before and after a node on each level."""
    steps = []
    while len(nodes) > 1:
        first = at // fan * fan
        run = nodes[first : first + fan]
        steps.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        nodes, at = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)], at // fan
    return nodes[0], steps


def brute(rows, fan):
    leaf = lambda r: h(*map(enc, r))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    subs = [climb([leaf(r) for r in held[s]], 0, fan)[0] for s in sources]
    out = []
    for k, s in enumerate(sources):
        root, above = climb(subs, k, fan)
        for at, r in enumerate(held[s]):
            steps = climb([leaf(x) for x in held[s]], at, fan)[1] + above
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            got = h(*map(enc, (*r[:4], text)))
            for a, b in steps:
                got = h(a, got, b)
            out.append((r[0], leaf(r), subs[k], root, h(*[a + b for a, b in steps]), got, got == root))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "no": F.lit(2), "a.b": F.lit(3)})
    found = merkle.merkle_proofs(docs, tampered={"text": merkle.tampered_text()}, **options)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize(("sizes", "fan", "band"), [((1,), 3, 5), ((1, 1), 3, 5), ((3, 4, 9, 10, 1), 3, 1), ((30, 82, 2), 3, 2), ((5, 17, 64), 2, 3), ((100, 7), 5, 2)])
def test_proofs_equal_brute_force(spark, sizes, fan, band):
    rng = random.Random(str(sizes))
    rows = []
    for k, n in enumerate(sizes):
        source = None if k == 1 else f"é{k}" if k % 2 else f"s{k}"
        rows += [(rng.randint(0, 10**6), source, rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "a\nb\n", "ü\n" * 5, "plain"])) for _ in range(n)]
    assert run(spark, rows, fan=fan, band=band) == brute(rows, fan)


def test_odd_rows(spark):
    rows = [(1, "a", None, None, None)] * 7 + [(None, "a", "en", 1, "x\n"), (None, None, None, None, None), (1, "a", "en", 1, "y"), (1, "", "en", 1, "y")]
    assert run(spark, rows, band=1) == brute(rows, 3)
    assert run(spark, rows[:0]) == []


def test_hot_source_is_many_ranges(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'hot' AS source", "'en' AS lang", "1L AS n_chars", "'t' AS text")
    leaves = docs.select(F.col("doc_id").alias("id"), "source", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(0).alias("salt"))
    placed = merkle.placed(leaves)
    assert placed.select(F.spark_partition_id()).distinct().count() >= 1
    assert [r["at"] for r in placed.orderBy("id").collect()] == list(range(3000))
