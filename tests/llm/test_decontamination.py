"""Matches against brute force over all windows; recall of the LSH at the largest distance."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import decontamination as dc
from lodestar.llm.queries import QUERIES
from tests.llm.helpers import SMALL


def semi_global(pattern, text):
    """Edit distance of a pattern to the best part of a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        row, last = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=70), st.lists(st.sampled_from("abcde"), max_size=60))
def test_distance(pattern, text):
    assert dc.substring_distance(pattern, text) == semi_global(pattern, text)


def normal(text):
    _, starts, ends, data = dc.word_spans(pa.array([text]))
    return [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]


def brute(docs, items, rate=0.2):
    out = set()
    for d, text in docs:
        w = normal(text)
        for i, item in items:
            p = normal(item)
            if len(p) >= dc.SHORTEST and (len(set(p) & set(w)) > len(set(p)) / 3) and (k := semi_global(p, w)) <= int(len(p) * rate):
                out.add((d, i, k))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB9é. -“”—。、ß\u00a0\n\u4e2d", max_size=12)), max_size=6))
def test_words(texts):
    offsets, starts, ends, data = dc.word_spans(pa.array(texts, pa.string()))
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [re.findall("[^\x00-/:-@\\[-`{-\x7f\x80-\xbf\u2000-\u207f\u3000-\u303f]+", (t or "").lower()) for t in texts]
    h = dc.hashed(starts, ends, data, at_once=3)
    flat = [w for row in got for w in row]
    assert (h == dc.hashed(starts, ends, data)).all() and len(set(h.tolist())) == len(set(flat))


def test_table_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.distance) for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    assert got == brute(docs, items) and got


def edited(rng, terms, k, vocabulary):
    terms = list(terms)
    for _ in range(k):
        at = rng.randrange(len(terms))
        kind = rng.randrange(3)
        terms[at : at + (kind != 0)] = [] if kind == 2 and len(terms) > 1 else [rng.choice(vocabulary)]
    return terms


def test_recall_at_the_largest_distance(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of"] * 400
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 60)))) for i in range(60)]
    docs = []
    for d in range(240):
        terms = items[d % 60][1].split()
        part = edited(rng, terms, int(len(terms) * 0.2), vocabulary)
        docs.append((d, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 200)), *part, *rng.choices(vocabulary, k=rng.randint(0, 200))]).title()))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.benchmark_matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= {(d, d % 60) for d in range(240)}
    assert len(got) >= 0.9 * 240


def test_key_of_equal_windows():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = dc.embedding_keys(np.concatenate([h[:50], h[20:90]]), np.array([20, 50]), np.array([45, 75]), 25)
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == dc.REPEATS


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x y {item.upper()}! z"), (1, f"x y {item.upper()}! z"), (2, None), (3, ""), (4, "clean text"), (None, item), (5, ("pad " * 30_000) + item + " pad" * 30_000), (6, "a b c d e f g"), (7, item.replace("three", "3").replace("nine ", ""))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(10, item), (11, item.title() + "."), (12, None), (13, "a b c"), (14, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in dc.benchmark_matches(docs, bench).collect()}
    assert got == {(d, i, 2 if d == 7 else 0) for d in (1, None, 5, 7) for i in (10, 11)}
    kept = dc.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert dc.decontaminated(docs, bench.limit(0)).count() == len(rows)
    assert dc.benchmark_matches(docs.limit(0), bench).count() == 0


def units(text):
    _, starts, ends, data = dc.unit_spans(pa.array([text]))
    return [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aB9é. -“。，？・＝ß\n中かー\U00020000\U0001f600한ก", max_size=12), max_size=6))
def test_units(texts):
    offsets, starts, ends, data = dc.unit_spans(pa.array(texts, pa.string()))
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [re.findall("[中かー\U00020000ก]|[ab9éß\U0001f600한]+", t.lower()) for t in texts]


def test_short_items_are_held_word_for_word(spark):
    items = [(1, "Who wrote the Odyssey?"), (2, "the red fox jumps over dogs"), (3, "one two three"), (4, "wrote the odyssey who")]
    rows = [(1, "Quiz: who wrote -- the ODYSSEY, and when"), (1, "who wrote the odyssey"), (2, "the red fox leaps over dogs"), (3, "the red fox jumps over dogs"), (4, "who wrote the"), (5, "odyssey"), (None, "who wrote the odyssey"), (6, "one two three"), (7, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda **args: {tuple(r) for r in dc.benchmark_matches(docs, bench, **args).collect()}
    assert found() == {(1, 1, 0, 4), (None, 1, 0, 4), (3, 2, 0, 6)}
    assert found(least=1) == found() | {(6, 3, 0, 3)}
    assert sorted(r.doc_id for r in dc.decontaminated(docs, bench).collect()) == [2, 4, 5, 6, 7]


def test_items_without_blanks(spark):
    rng = random.Random(5)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    items = [(1, text(300)), (2, text(20) + "，" + text(20) + "？"), (3, "日本の首都"), (4, "เมืองหลวงของประเทศไทย")]
    edited = items[1][1].replace("，", "").replace(items[1][1][7], "x").replace(items[1][1][30], "")
    docs = [(1, "前" * 30 + items[0][1] + "後"), (2, text(50) + edited + text(50)), (3, "質問：日本の首都はどこ"), (4, "ถาม" + items[3][1]), (5, text(400))]
    got = dc.benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 0, 300), (2, 2, 2, 40), (3, 3, 0, 5), (4, 4, 0, len(items[3][1]))}
