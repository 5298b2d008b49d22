"""Each stage's rows against a brute-force version on its own input."""

from collections import Counter

import corpus_pipeline
from lodestar.llm import toxicity
from lodestar.llm.common import table, written
from tests.llm.helpers import SMALL
from tests.llm.test_decontamination import brute
from tests.llm.test_simhash import brute_near


def test_stages_equal_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns, states = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SMALL), f"test-{name}")
        states.append((name, before, docs.collect()))
        assert docs.columns[: len(columns)] == columns
    assert [s[0] for s in states] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = [{r.doc_id for r in after} for _, _, after in states]

    before = states[0][1]
    frame = table(spark, SMALL, "documents")
    model = toxicity.train(frame, table(spark, SMALL, "labels"))
    import pyarrow as pa

    scores = model.scores(model.features(pa.array([r.text for r in before]), {}))
    assert kept[0] == {r.doc_id for r, s in zip(before, scores, strict=True) if s < 0.5}

    before = states[1][1]
    ordered = sorted(before, key=lambda r: r.doc_id)
    groups = brute_near([r.text for r in ordered])
    assert kept[1] == {ordered[g].doc_id for g in set(groups)} and len(states[1][2]) == len(kept[1])

    before = states[2][1]
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").collect()]
    hit = {d for d, _, _ in brute([(r.doc_id, r.text) for r in before], items)}
    assert hit and kept[2] == {r.doc_id for r in before} - hit

    _, before, after = states[3]
    times = Counter(r.doc_id for r in after)
    texts = {r.doc_id: r for r in before}
    assert set(times) <= set(texts) and max(times.values()) <= 3
    assert all((r.text, r.source) == (texts[r.doc_id].text, texts[r.doc_id].source) for r in after)
    sizes = {d: len((r.text or "").split()) for d, r in texts.items()}
    by_source = Counter()
    for d, r in texts.items():
        by_source[r.source] += sizes[d]
    weights, level, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by_source))}, 0.0, sum(by_source.values())
    capped: set = set()
    while True:
        level = (total - sum(3 * by_source[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s, w in weights.items() if s not in capped and level * w > 3 * by_source[s]}
        if not over:
            break
        capped |= over
    largest = max(sizes.values())
    for s in by_source:
        taken = sum(n * sizes[d] for d, n in times.items() if texts[d].source == s)
        assert abs(taken - min(3 * by_source[s], level * weights[s])) <= largest

    _, before, after = states[4]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    counts = Counter(r.shard for r in after)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in after if r.shard == k) == list(range(n)) for k, n in counts.items())


def test_empty_and_run(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "test-empty")
        assert docs.count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SMALL).count() > 0
