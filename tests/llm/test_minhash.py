"""Groups by exact Jaccard similarity against brute force, recall of the tables, odd rows, and large groups."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import minhash, rounds

WORDS = [f"w{i}" for i in range(400)]


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))


def brute(rows):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        least = (k if not sets[i] else min(ids, default=None))
        out.append((k, len(sets[i]), least, k is not None and k == least))
    return sorted(out, key=repr)


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def corpus(rng):
    rows = []
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 120))]
        rows.append(" ".join(base))
        for share in (0.0, 0.02, 0.05, 0.1, 0.3):
            rows.append(" ".join(edited(rng, base, share)))
        rows.append(" ".join(base + base[: len(base) // 2]))
        rows.append(" ".join(base[: -(len(base) // 8) or None]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    texts = corpus(rng) + ["one", "ONE ", "one two", None, None, "", " \n", "é É", "É É"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, "other words here"), (None, texts[7]), (None, "no other has this")]
    got = sorted(map(tuple, minhash.minhash_groups(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("small", [16, 1])
def test_large_group_with_texts_outside(spark, monkeypatch, small):
    """A group whose members are alike by different degrees, and many that are near it and outside: in small buckets, and where they meet in place."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.random() * 0.12)) for _ in range(250)))
    got = sorted(map(tuple, minhash.minhash_groups(frame(spark, rows)).collect()), key=repr)
    want = brute(rows)
    assert len({r[2] for r in want}) > 3
    assert got == want


def test_recall_of_the_tables():
    """Pairs of 0.80 to 0.83 share a table in over 99 of 100 cases."""
    rng, found, n = random.Random(3), 0, 0
    while n < 400:
        common, own = rng.randint(8, 200), rng.randint(1, 20)
        j = common / (common + 2 * own)
        if not 0.8 <= j <= 0.83:
            continue
        h = np.array([rng.getrandbits(64) for _ in range(common + 2 * own)], np.uint64)
        sets = [np.sort(h[: common + own]), np.sort(np.concatenate([h[:common], h[common + own :]]))]
        keys = minhash.half_keys(np.concatenate(sets), np.array([len(s) for s in sets]))
        same = keys[0] == keys[1]
        found, n = found + bool(same[: minhash.HALVES].any() and same[minhash.HALVES :].any()), n + 1
        bits = minhash.sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
        assert minhash.maybe_similar(bits[:1], bits[1:], np.array([sum(map(len, sets))]), 80)[0]
    assert found / n >= 0.99


def test_sets_and_minhashes():
    flat, counts = minhash.shingle_sets(pa.array(["a b a b c", "", None, "A", "a b c"]))
    assert counts.tolist() == [3, 0, 0, 1, 2]
    keys = minhash.half_keys(flat, counts[counts > 0])
    assert keys.shape == (3, 2 * minhash.HALVES) and len(set(keys[0].tolist())) == 2 * minhash.HALVES


def test_core_sizes(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (3, [9]), (4, [])], "node long, shingles array<long>")
    assert sorted(map(tuple, rounds.core_sizes(sets).collect())) == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_dedup_keeps_columns_and_one_row(spark):
    rows = [(1, "a b c d", "x"), (2, "A b c d", "y"), (2, "a b c d", "y2"), (3, "other text", "z"), (None, "a b c d", "n"), (4, None, "e"), (5, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _order string").withColumnRenamed("_order", "_kept_id").selectExpr("doc_id", "text", "_kept_id", "1 AS _order", "2 AS `n.x`")
    kept = minhash.minhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert minhash.minhash_groups(docs.limit(0)).count() == 0
