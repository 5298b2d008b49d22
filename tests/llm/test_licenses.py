"""Scores by hand and by SQL, inheritance on a small tree."""

import math

from lodestar.llm import licenses
from lodestar.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import assert_equals_oracle

SMALL = "/root/testdata/sf0.001"


def test_whole_table(spark):
    assert_equals_oracle(spark, QUERIES["op1_license_scan"], ORACLES["op1_license_scan"])
    assert_equals_oracle(spark, QUERIES["op1_license_scan"], ORACLES["op1_license_scan"], "/root/testdata/sf0.01")


def brute(segment, templates):
    """Cosine to every template, over all terms, without anchors."""
    n = len(templates)
    bags = {name: licenses.terms(text) for name, text in templates}
    idf = lambda t: math.log((1 + n) / (1 + sum(t in b for b in bags.values()))) + 1
    mine = licenses.terms(segment)
    dot = lambda a, b: sum(a.count(t) * b.count(t) * idf(t) ** 2 for t in {*a, *b})
    return {name: dot(mine, b) / math.sqrt(dot(mine, mine) * dot(b, b)) if mine else 0.0 for name, b in bags.items()}


def test_anchors_lose_nothing():
    index = licenses.TemplateIndex(list(licenses.TEMPLATES), 0.6)
    words = "licensed under the apache license version 2 0 cc by nc gnu general public all rights reserved mit released work is a b".split()
    import random

    rng = random.Random(3)
    for _ in range(600):
        segment = " ".join(rng.choices(words, k=rng.randint(1, 12)))
        want = brute(segment, licenses.TEMPLATES)
        top = max(want.values())
        got = index.best(segment)
        if abs(top - 0.6) > 1e-6:
            assert (got is not None) == (top >= 0.6), segment
        if got:
            assert math.isclose(got[0], top, abs_tol=1e-8) and math.isclose(want[got[1]], top, abs_tol=1e-8)


def test_tree_and_odd_rows(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("a/LICENSE", mit), ("a/b/COPYING.txt", "prose\nmore prose\n\n" + apache), ("a/x.py", "none"), ("a/b/c/d/y.py", None),
        ("a/b/z.py", "# " + mit + "\ncode"), ("ab/w.py", ""), ("w.py", "x" * 300_000), ("a/q.py", "none"), ("a/q.py", "none"),
        (None, apache), (None, "none"), ("c/LICENSE", "nothing here"), ("c/v.py", "text"), ("d/NOTICE-1", mit), ("d/NOTICE-2", apache), ("d/u.py", "t"),
    ]
    files = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, license int")
    got = sorted(((r.path, r.license, r.inherited_from) for r in licenses.license_scan(files).collect()), key=str)
    want = [
        ("a/LICENSE", "MIT", None), ("a/b/COPYING.txt", "Apache-2.0", None), ("a/x.py", "MIT", "a"), ("a/b/c/d/y.py", "Apache-2.0", "a/b"),
        ("a/b/z.py", "MIT", None), ("ab/w.py", None, None), ("w.py", None, None), ("a/q.py", "MIT", "a"), ("a/q.py", "MIT", "a"),
        (None, "Apache-2.0", None), (None, None, None), ("c/LICENSE", None, None), ("c/v.py", None, None),
        ("d/NOTICE-1", "MIT", None), ("d/NOTICE-2", "Apache-2.0", None), ("d/u.py", "Apache-2.0", "d"),
    ]
    assert got == sorted(want, key=str)
    assert licenses.license_scan(files.limit(0)).count() == 0


def test_notices_that_share_their_line():
    index = licenses.TemplateIndex(list(licenses.TEMPLATES), 0.6)
    prose = " ".join(f"word{i}" for i in range(40))
    for name, notice in licenses.TEMPLATES:
        assert index.scan(f"{prose} {notice[:-1]} {prose}", False) == (1.0, name)
        assert index.scan(f"{prose}\n# {notice.replace(' ', chr(10), 3)} {prose}", False) == (1.0, name)
    assert index.scan("# Copyright 2019 The Foo Authors. All rights reserved.", False) == (1.0, "Proprietary")
    assert index.scan(f"{prose}. MIT License. {prose}", False)[1] == "MIT"
    assert index.scan(f"Er kam mit. Mit! {prose} all rights of {prose}, released under the new license {prose}", False) is None


def test_windows_equal_brute_force():
    import random

    index = licenses.TemplateIndex(list(licenses.TEMPLATES), 0.6)
    words = "licensed under the apache license version 2 0 all rights reserved mit released work a".split()
    rng = random.Random(4)
    for _ in range(40):
        segment = rng.choices(words, k=rng.randint(3, 30))
        for k, name in enumerate(index.names):
            n = index.sizes[k]
            want = max((brute(" ".join(segment[i : i + n]), licenses.TEMPLATES)[name] for i in range(len(segment) - n + 1)), default=0.0)
            got = index.windows(segment, k, 0.0)
            assert math.isclose(got[0], want, abs_tol=1e-8)
