"""Automata against edit distance, context by hand, held-out accuracy."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import toxicity
from lodestar.llm.queries import QUERIES
from lodestar.llm.toxicity import Lexicon, allowed_edits, evidence

CHECKED = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


WORDS = st.text("abc", min_size=4, max_size=10)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6, unique=True), WORDS, st.integers(0, 10**6))
def test_automaton_equals_edit_distance(terms, word, seed):
    rng, word = random.Random(seed), list(rng_word(random.Random(seed), terms, word))
    word = "".join(word)
    near = sorted((distance(word, t), t) for t in terms if distance(word, t) <= allowed_edits(t))
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))
    assert lexicon.near(word) == ((near[0][1], near[0][0]) if near else None)
    if near and near[0][0]:
        assert lexicon.maybe_near(pa.array([word]))[0] or len(word) < 4


def rng_word(rng, terms, word):
    base = list(rng.choice([*terms, word]))
    for _ in range(rng.randint(0, 2)):
        at = rng.randrange(len(base) + 1)
        base[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
    return "".join(base) or word


def test_context():
    strength = {"idiot": 0.9}
    abuse = evidence("you are an idiot.", strength)
    quote = evidence('he said “what an idiot” and left', strength)
    assert abuse[0] > 0.8 and quote[0] < 0.4 and quote[2] > 0.8 and abuse[2] == 0
    assert evidence("nothing here", strength) == [0.0, 0.0, 0.0]
    assert evidence('"' * 2000 + " idiot", strength)[0] > 0


def test_held_out(spark):
    labels = spark.read.parquet(f"{CHECKED}/labels.parquet").filter("toxic IS NOT NULL")
    got = QUERIES["op7_toxicity"](spark, CHECKED).cache()
    assert got.count() == spark.read.parquet(f"{CHECKED}/documents.parquet").count()
    assert got.filter("score NOT BETWEEN 0 AND 1 OR predicted <> int(score >= 0.5) OR held_out IS NULL").count() == 0
    held = got.filter("held_out").join(labels, "doc_id")
    assert held.filter("crc32(string(doc_id)) % 5 <> 0").count() == 0
    cells = {(r.toxic, r.predicted): r.n for r in held.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    right, missed, wrong = cells[1, 1], cells.get((1, 0), 0), cells.get((0, 1), 0)
    assert right / (right + missed) >= 0.85 and right / (right + wrong) >= 0.85


def test_misspelled_and_odd_rows(spark):
    rng = random.Random(5)
    clean = ["garden", "window", "paper", "river", "quiet", "music", "table", "lamp", "stone", "cloud"]
    text = lambda *more: " ".join(rng.choices(clean, k=30) + list(more))
    rows = [(i, text(*(["dreadful", "moron"] if i % 4 == 0 else []))) for i in range(600)]
    odd = [(9000, text("dreadfull", "morron")), (9001, text()), (9002, None), (9003, ""), (9004, "moron " * 20_000), (None, "moron dreadful"), (1, text()), (1, text())]
    docs = spark.createDataFrame([(*r, "k") for r in rows + odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (3, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.toxicity_scores(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == len(rows) + len(odd)
    verdict = {r.doc_id: r.predicted for r in got.collect()}
    assert verdict[9000] == verdict[9004] == verdict[None] == 1
    assert verdict[9001] == verdict[9002] == verdict[9003] == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.toxicity_scores(docs, nothing).filter("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0
