"""Fingerprints and groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import components, simhash
from lodestar.llm.components import connected_components
from lodestar.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute_print(text):
    terms = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not terms:
        return 0
    shingles = [" ".join(terms[i : i + 4]) for i in range(max(1, len(terms) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest id reachable of each id, over links of at most 4 bits."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and (a := top(i)) != (b := top(j)):
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('the quick brown fox é') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("the quick brown fox é".encode(), 42)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    got = QUERIES["op9_simhash"](spark, SMALL).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_groups(prints)
    assert len(got) == len(docs)


@pytest.mark.parametrize("bucket_rows", [2048, 7])
def test_links_equal_brute_force(spark, bucket_rows):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0]
    prints = set(centres)
    for c in centres:  # dense balls and chains around the centres
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            prints.add(x)
    prints |= {rng.getrandbits(20) << 44 for _ in range(60)}  # one hot bucket
    rows = {i: p for i, p in enumerate(sorted(prints, key=lambda p: p * 7919 % 1000003))}
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in rows.items()], "id long, fp long")
    edges = simhash.links(frame, bucket_rows=bucket_rows)
    assert edges.filter("a is null or b is null").count() == 0
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert {i: roots.get(i, i) for i in rows} == brute_groups(rows)


@pytest.mark.parametrize("edges_a_task", [components.EDGES_A_TASK, 40])
def test_components_of_a_long_path(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(components, "EDGES_A_TASK", edges_a_task)
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    extra = spark.createDataFrame([(900, 900), (None, 3), (700, 701), (701, 700)], "a long, b long")
    got = {r.node: r.root for r in connected_components(path.unionByName(extra)).collect()}
    assert got == {i: 0 for i in range(301)} | {700: 700, 701: 700}
    assert connected_components(path.limit(0)).count() == 0


def test_odd_rows(spark):
    texts = [(5, None), (3, ""), (9, " \n"), (1, "one two"), (2, "ONE  two"), (2, "ONE  two"), (None, "one two"), (None, "alone"), (4, "word " * 5000), (6, "word " * 5001)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (2, 1), (None, 1), (None, None), (4, 4), (6, 4)], key=str)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    # "word word ..." of any length from five on has one shingle of five words, and blank texts have none
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([3, 1, None, 4], key=str)
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def shingle_sets(text):
    terms = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(terms[i : i + 5]) for i in range(max(1, len(terms) - 4))} if terms else set()


def brute_near(texts):
    """Groups of texts by links of near duplicates, each pair compared: of each text the smallest number in its group."""
    import pyarrow as pa

    prints = simhash.pair_prints(pa.array(texts, pa.string()))
    sets, root = [shingle_sets(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        close = np.flatnonzero((np.bitwise_count(prints[:i] ^ prints[i]) <= 4).any(axis=1))
        for j in close.tolist():
            common = len(sets[i] & sets[j])
            if common >= 0.8 * len(sets[i] | sets[j]) and (a := top(i)) != (b := top(j)):
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_vectorised_hash():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts, lengths = rng.integers(0, 4800, 4000), rng.integers(0, 200, 4000)
    got = simhash.xxh64(data, starts, lengths, 7)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[i : i + n].tobytes(), 7) for i, n in zip(starts, lengths, strict=True)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 3000])
def test_near_groups_equal_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = ["", " ", "one", "One", "one two three four five six"]
    for n in (9, 40, 120, 300):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(25):  # near copies, some far from each other but tied by those between them
            edited = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                edited[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = simhash.near_groups(frame, block_bytes=block_bytes).collect()
    least = {r.least: r.root for r in groups}
    first = {}
    for i in sorted(least):
        first.setdefault(least[i], i)
    named = {i: first[r] for i, r in least.items()}
    ids = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = brute_near(texts)
    assert {i: named[i] for i in named} == {i: ids[texts[want[i]]] for i in named}


def test_recall_of_near_copies(spark):
    """Texts that share 0.8 to 0.85 of their shingles are linked in over nine of ten cases."""
    import pyarrow as pa

    rng, found, tried = random.Random(9), 0, 0
    vocabulary = [f"w{int(rng.paretovariate(0.9))}" for _ in range(5000)]
    while tried < 300:
        n = rng.randint(60, 400)
        base = [rng.choice(vocabulary) for _ in range(n)]
        edited = list(base)
        for _ in range(rng.randint(1, n // 20)):
            edited[rng.randrange(n)] = rng.choice(vocabulary)
        a, b = shingle_sets(" ".join(base)), shingle_sets(" ".join(edited))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            tried += 1
            p = simhash.pair_prints(pa.array([" ".join(base), " ".join(edited)]))
            found += int(np.bitwise_count(p[0] ^ p[1]).min() <= 4)
    assert found / tried >= 0.9


def test_repeated_ids_and_odd_columns(spark):
    rows = [(1, "p q r s t", 1), (2, "p q r s t", 2), (2, "other text here now again", 3), (1, "zz yy xx ww vv", 4), (1, "p q r s t", 5), (None, "p q r s t", 6), (None, "left alone here by all", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _order long").selectExpr("*", "map('a', _order) AS m", "doc_id AS digest")
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", "p q r s t"), ("2", "other text here now again"), ("1", "zz yy xx ww vv"), ("None", "left alone here by all")])
    assert len({tuple(map(str, r)) for r in simhash.simhash_dedup(docs).collect()} ^ {tuple(map(str, r)) for r in got}) == 0


@pytest.mark.parametrize("shared", [2, 3, 4])
def test_any_number_of_equal_blocks(spark, shared):
    rng = random.Random(2)
    rows = {}
    for i in range(60):
        c = rng.getrandbits(64)
        for j in range(4):
            rows[4 * i + j] = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                rows[4 * i + j] ^= 1 << b
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in rows.items()], "id long, fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(frame, shared=shared)).collect()}
    assert {i: roots.get(i, i) for i in rows} == brute_groups(rows)
    assert simhash.shared_blocks(200_000, 4) == 2 < simhash.shared_blocks(2 * 10**10, 4)


def test_known_groups_are_one_node():
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.repeat(heads, 8) ^ (np.uint64(1) << rng.integers(0, 64, 240).astype(np.uint64))
    ids = rng.integers(0, 120, 240)
    run = np.sort(rng.integers(0, 3, 240))
    a, b = simhash._forest(run, fp, 4, simhash.pivots(16), ids=ids)
    assert all(run[x] == run[y] and ids[x] != ids[y] and int(fp[x] ^ fp[y]).bit_count() <= 4 for x, y in zip(a, b, strict=True))

    def groups(edges):
        label = list(range(240))
        for x, y in edges:
            low, high = sorted((label[x], label[y]))
            label = [low if z == high else z for z in label]
        return label

    same = [(x, y) for x in range(240) for y in range(x) if run[x] == run[y] and ids[x] == ids[y]]
    near = [(x, y) for x in range(240) for y in range(x) if run[x] == run[y] and int(fp[x] ^ fp[y]).bit_count() <= 4]
    forest = groups([*same, *zip(a.tolist(), b.tolist(), strict=True)])
    assert forest == groups([*same, *near])
    # a forest: every edge joins two groups
    assert len(a) == len(set(groups(same))) - len(set(forest))


def test_many_edges_of_a_group_are_thinned(spark):
    """A group of 400 nodes with 60,000 edges comes into the rounds with fewer edges than nodes, and the components stay."""
    rows = spark.range(60_000).select((F.xxhash64("id") % 200 + 300).alias("a"), (F.xxhash64("id", F.lit(1)) % 200 + 300).alias("b")).unionByName(spark.createDataFrame([(900, 901), (902, 901), (905, 905)], "a long, b long"))
    ends = rows.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    assert components._thinned(ends, 1).count() < 410 < ends.count()
    want = {r.x for r in ends.select(F.explode(F.array("u", "v")).alias("x")).distinct().collect()}
    got = {r.node: r.root for r in components.connected_components(rows).collect()}
    low = min(x for x in want if x < 900)
    assert got == {x: 900 if x >= 900 else low for x in want}
