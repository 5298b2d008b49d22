"""The search index, vector cells, name index, interval labels and bucketed tables: plans, recall and small cases by hand."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.runs import packed, packed_runs
from lodestar.operators import documents, search, tree
from lodestar.operators.cells import VectorCells
from lodestar.operators.index import SearchIndex, content_key
from lodestar.operators.names import NameIndex, inner_trigrams
from lodestar.plans import indexing, registry, retrieval
from lodestar.sources import drive
from lodestar.sources.drive import table

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, 1 if i < 40 else 2, f"o{i % 30}", f"file-{i}.txt", "text/plain", "f", 10, i % 11 == 5) for i in range(50)]
    return spark.createDataFrame(rows, "file_id long, owner_id int, object_id string, name string, mime_type string, folder_id string, size_bytes long, deleted boolean")


def chunk_rows(spark, texts):
    return documents.index_rows(documents.chunked(spark.createDataFrame(list(texts.items()), "object_id string, text string")), "p", "m")


WORDS = "red blue green stone river cloud bird house lamp door".split()


def test_index_equals_the_scan(spark, entries, tmp_path):
    rng = random.Random(3)
    texts = {f"o{i}": " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 700))) for i in range(30)}
    rows = chunk_rows(spark, texts)
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.add(rows, segment_rows=9)
    # more segments and blocks than one, and then a second generation that replaces some objects
    newer = {f"o{i}": " ".join(rng.choice(WORDS[:5]) for _ in range(50)) for i in range(0, 30, 4)}
    for step in range(2):
        if step:
            index.add(chunk_rows(spark, newer), segment_rows=9)
            rows = chunk_rows(spark, texts | newer)
        for query in ("red stone", "bird", "red blue green stone", "nothing red", "lamp lamp door"):
            for mode, scan in (("fulltext_candidates", search.fulltext_candidates), ("semantic_candidates", search.semantic_candidates)):
                wanted = search.SearchInput(query, limit=3 if step else 100, owner_id=1)
                got = sorted(map(tuple, getattr(index, mode)(entries, wanted).collect()))
                assert got == sorted(map(tuple, scan(entries, rows, wanted).collect())), (query, mode, step)


def test_index_reads_the_terms_of_the_query_only(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.add(chunk_rows(spark, {f"o{i}": f"word{i} common text" for i in range(20)}))
    assert index.term_frequencies(["common", "word3", "absent"]) == {"common": 20, "word3": 1}
    text = plan(index.fulltext_scores("word3 common"))
    scans = re.findall(r"FileScan parquet .*", text)
    assert len(scans) == 2 and all("EqualTo(term," in s and "content" not in s for s in scans)
    assert [tuple(r)[1] for r in index.fulltext_scores("word3 common").collect()] == [0.1]


def test_index_build_sends_no_occurrences(spark, tmp_path):
    """Postings and places are made where the chunks are read; before, each word and each number of a vector was a row of a shuffle."""
    rng = random.Random(7)
    rows = chunk_rows(spark, {f"o{i}": " ".join(rng.choice(WORDS) for _ in range(2000)) for i in range(20)})
    rows.write.parquet(f"file://{tmp_path}/rows")
    rows, store, jvm = spark.read.parquet(f"file://{tmp_path}/rows"), spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def sent():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = sent()
    SearchIndex(spark, f"file://{tmp_path}/i").add(rows)
    assert sum(n for k, n in sent().items() if k not in before) < 1000


def test_blocks_that_two_tasks_read(spark, entries, tmp_path):
    rng = random.Random(5)
    rows = chunk_rows(spark, {f"o{i}": " ".join(rng.choice(WORDS) for _ in range(900)) for i in range(30)}).coalesce(1)
    index, name = SearchIndex(spark, f"file://{tmp_path}/i"), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set("parquet.block.size", 20_000)
    spark.conf.set(name, "20000")
    try:
        index.add(rows)
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("parquet.block.size")
    wanted = search.SearchInput("red stone", limit=100, owner_id=1)
    assert sorted(map(tuple, index.fulltext_candidates(entries, wanted).collect())) == sorted(map(tuple, search.fulltext_candidates(entries, rows, wanted).collect()))
    assert sorted(map(tuple, index.semantic_candidates(entries, wanted).collect())) == sorted(map(tuple, search.semantic_candidates(entries, rows, wanted).collect()))


def test_texts_of_objects_are_sent_once(spark):
    """One exchange of texts; before, they went to a join and then again to their object."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(drive.objects(spark, SMALL)).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_are_packed_at_once():
    values = np.concatenate([np.arange(-100, 100), np.arange(-30_000, 30_000, 999), [1 << 40, 127, 128, -128, -129]])
    starts = np.array([0, 3, 60, 199, 200, 230, len(values) - 5, len(values) - 4, len(values) - 2])
    ends = np.append(starts[1:], len(values))
    assert packed_runs(values, starts, ends).to_pylist() == [packed(values[i:j]) for i, j in zip(starts, ends, strict=True)]


def test_content_key_follows_the_files(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(at)
    first = content_key(spark, at)
    assert first == content_key(spark, at)
    spark.range(4).write.mode("overwrite").parquet(at)
    assert first != content_key(spark, at)


def test_cells_recall_and_pruning(spark, tmp_path):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    cells = VectorCells(spark, f"file://{tmp_path}/c")
    cells.build(vectors)
    found = total = 0
    for row in vectors.filter("vec_id % 100 = 0").collect():
        got = {r.vec_id for r in cells.topk(row.embedding, 40).collect()}
        want = {r.vec_id for r in search.cosine_topk(vectors, row.embedding, 40).collect()}
        found, total = found + len(got & want), total + len(want)
    assert found / total >= 0.9
    first = vectors.first().embedding
    near = cells.topk(first, 40, probes=3)
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan(near))
    everything = cells.topk(first, 40, probes=10_000)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, search.cosine_topk(vectors, first, 40).collect()))


@pytest.mark.parametrize("query", ["small gear", "gear", "all ge", "g_ar", "ear%12", "xyzzy", "ge", "ROUND widget-1", ".txt"])
def test_name_index_equals_the_scan(spark, tmp_path, query):
    files = drive.entries(spark, SMALL)
    index = NameIndex(spark, f"file://{tmp_path}/n")
    index.build(files)
    wanted = search.SearchInput(query, "name", 50)
    assert sorted(map(tuple, index.search(wanted).collect())) == sorted(map(tuple, search.name_search(files, wanted).collect()))


def test_name_index_scores_few_names(spark, tmp_path):
    rows = [(i, f"{''.join(random.Random(i).choices('abcdefghij', k=9))}-{i}.txt") for i in range(3000)] + [(9999, "quarterly report.pdf")]
    files = spark.createDataFrame(rows, "file_id long, name string").withColumns({"owner_id": F.lit(1), "deleted": F.lit(False), "folder_id": F.lit("f"), "mime_type": F.lit("t")})
    index = NameIndex(spark, f"file://{tmp_path}/n")
    index.build(files)
    assert 1 <= index.candidates("quarterly report").count() <= 30
    assert inner_trigrams("ab cde") == ["ab ", "  c", " cd", "cde"]
    assert inner_trigrams("x") == []


def test_interval_labels(spark):
    rng = random.Random(5)
    rows = [("r0", None), ("r1", None), ("loop1", "loop2"), ("loop2", "loop1"), ("orphan", "gone")]
    parents = ["r0", "r1"]
    for i in range(120):
        rows.append((f"f{i}", rng.choice(parents)))
        parents.append(f"f{i}")
    folders = spark.createDataFrame(rows, "folder_id string, parent_id string")
    labels = tree.interval_labels(folders).collect()
    of = {r.folder_id: r for r in labels}
    up = dict(rows)
    assert sorted(of) == sorted(x for x, _ in rows if x not in ("loop1", "loop2", "orphan"))
    assert sorted(r.pre for r in labels) == list(range(len(labels)))

    def above(x):
        while x is not None:
            yield x
            x = up[x]

    for x in of:
        chain = list(above(x))
        assert of[x].depth == len(chain) - 1
        assert {y for y in of if of[y].pre <= of[x].pre < of[y].pre + of[y].size} == set(chain)
    assert tree.interval_labels(folders.limit(0)).count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark):
    files, chunks = indexing.stored_by_object(spark, SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(search.fulltext_candidates(files, chunks, retrieval.WANTED))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_chunks_of_whole_texts(spark):
    """Without a bound a text has the chunks that a plain loop cuts; before, 256 was the most that a caller got without a number."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab é😀", k=n)).strip() or "a" for n in (1, 1039, 1040, 1041, 1199, 1200, 1201, 1360, 2239, 2240, 2241, 2400, 5000, 400_000)]
    rows = documents.chunked(spark.createDataFrame(list(enumerate(texts)), "object_id long, text string"), most=None).collect()
    for i, whole in enumerate(texts):
        clean, want, start = " ".join(whole.split()), [], 0
        while True:
            want.append(clean[start : start + 1200])
            if start + 1200 >= len(clean):
                break
            start += 1040
        assert [(r.ordinal, r.content) for r in sorted(rows, key=lambda r: r.ordinal) if r.object_id == i] == list(enumerate(want))


def test_postings_search_reads_whole_texts(spark, tmp_path):
    """The terms stand after the 256th chunk of one text; before, only the beginning of a text was indexed. Queries whose SQL has that bound keep it."""
    filler = "stone " * 50_000
    docs = [(1, "s", filler + "the end of day and night " + filler), (5, "s", "the back of house and " + filler), (9, "s", "short")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], 1) for d in docs], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "ring")], "p_partkey long, p_name string").write.parquet(f"file://{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    places = {}
    for name in ("postings_search", "fulltext_search", "semantic_postings", "hybrid_search"):
        df, want = registry.QUERIES[name](spark, f"file://{tmp_path}"), con.sql(registry.ORACLES[name])
        got = df.select(*want.columns).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr), name
        places[name] = [(r.file_id, r.ordinal) for r in got if "ordinal" in df.columns]
    assert sorted(places["postings_search"]) == [(1, 288), (5, 0)]
    assert places["fulltext_search"] == [(5, 0)]
