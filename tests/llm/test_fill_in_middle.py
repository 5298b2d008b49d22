"""Ropes against string slices, and whole texts against the plain rule."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestar.llm import fill_in_middle as fim


def units(text, unit):
    return list(text) if unit == "char" else re.findall(r"[^\n]*\n|[^\n]+", text)


def height_ok(tree):
    return tree.left is None or (height_ok(tree.left) and height_ok(tree.right) and abs(tree.left.height - tree.right.height) <= 1)


@pytest.mark.parametrize("unit", ["line", "char"])
def test_ropes(unit, monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 7)
    rng = random.Random(unit)
    for _ in range(300):
        text = "".join(rng.choice("ab\n\n漢é ") for _ in range(rng.randint(0, 400)))
        cut, tree = units(text, unit), fim.rope(text, unit)
        assert (tree.units, tree.points, fim.text_of(tree)) == (len(cut), len(text), text)
        k = rng.randint(0, len(cut))
        a, b = fim.split(tree, k)
        assert (fim.text_of(a), fim.text_of(b)) == ("".join(cut[:k]), "".join(cut[k:]))
        assert (a.units, b.units) == (k, len(cut) - k)
        p = rng.randint(0, len(text))
        c, d = fim.split(fim.concat(b, a), p, "points")
        turned = "".join(cut[k:]) + "".join(cut[:k])
        assert (fim.text_of(c), fim.text_of(d)) == (turned[:p], turned[p:])
        assert height_ok(c) and height_ok(d)


def plain(doc_id, text, seed=7, rate=100, spm=50, unit="line"):
    cut = units(text or "", unit)
    n, x = len(cut), sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= rate:
        return text or "", "plain", n, None, None
    p, m, s = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), form, n, len(p), len(m)


@pytest.mark.parametrize(("unit", "rate"), [("line", 100), ("char", 60)])
def test_whole_texts(spark, unit, rate):
    rng = random.Random(4)
    texts = [None, "", "\n", "a", "a<P>b", "<S", "x<M\n>y", "<<P\n<S\n", "ends\n", "line\n" * 5000, "é" * 30000] + ["".join(rng.choice("ab <>PSM\n漢") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    rows = [*enumerate(texts), (3, "again\nand\nagain"), (None, "no\nid\nhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("old"), "N": F.lit(1), "x.y": F.lit(2)})
    done = fim.fim_restored(fim.fill_in_middle(docs, unit=unit, rate=rate))
    assert done.columns == ["doc_id", "text", "x.y", "fim_output", "form", "n", "prefix_chars", "middle_chars", "restored_text"]
    got = done.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fim_output, r.form, r.n, r.prefix_chars, r.middle_chars) == plain(r.doc_id, r.text, rate=rate, unit=unit)
        assert r.restored_text == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_sentinels_that_overlap_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "", "<M>"), ("<P>x", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)
