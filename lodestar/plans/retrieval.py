"""Search, fusion, evidence and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.checkpoints import is_file, shared_dir
from lodestar.functions.vectors import trigram_similarity
from lodestar.operators import rag, search, tree
from lodestar.operators.documents import MOST_CHUNKS, chunked, index_rows
from lodestar.operators.cells import VectorCells
from lodestar.operators.index import SearchIndex, content_key
from lodestar.operators.names import NameIndex
from lodestar.plans.files import PATHS_SQL, SCOPE
from lodestar.plans.registry import ORACLES, query
from lodestar.plans.texts import CHUNKS_SQL, HASHED_SQL, WHOLE_CHUNKS_SQL
from lodestar.sources.drive import ENTRIES_SQL, STATUS_SQL, document_status, entries, folders, objects, table

NAME, TERMS, OWNER = "small gear", "the of and", 1
WANTED = search.SearchInput(TERMS, "hybrid", 20, OWNER)


PIPELINE, MODEL = "p2", "m1"


def search_index(spark: SparkSession, sf_dir: str, most: int | None = MOST_CHUNKS) -> SearchIndex:
    """The index of the objects whose document is indexed, in the shared folder under a key of the tables' files; it is built where that has none.

    A table that is rewritten has another key, and an index that is lost is built again.
    It holds whole texts; a search finds the first ``most`` chunks of each, with None all.
    """
    key = content_key(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet")
    index = SearchIndex(spark, f"{shared_dir(spark)}/index-whole-{key}", most)
    if not index.exists():
        status = document_status(spark, sf_dir).filter("status = 'indexed'")
        index.add(index_rows(chunked(objects(spark, sf_dir).join(status, "object_id", "left_semi"), most=None), PIPELINE, MODEL))
    return index


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries without texts, in the shared folder under a key of the tables' files, as the hashes of all contents are not a query's work."""
    at = f"{shared_dir(spark)}/files-{content_key(spark, f'{sf_dir}/documents.parquet', f'{sf_dir}/part.parquet')}"
    if not is_file(spark, f"{at}/_SUCCESS"):
        entries(spark, sf_dir).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks of each text of the index, with their terms and vectors."""
    return search_index(spark, sf_dir).table("chunks").filter(F.col("ordinal") < MOST_CHUNKS).drop("chunk_id", "segment", "generation")


TRIGRAMS_SQL = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w)::BIGINT + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIM_SQL = "coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct({a} || {b})), 0)::DOUBLE, 0)"
NAME_SIM = SIM_SQL.format(a=TRIGRAMS_SQL.format(x="name"), b=TRIGRAMS_SQL.format(x=f"'{NAME}'"))


@query("trigram_similarity", f"SELECT DISTINCT p_name AS name, round({NAME_SIM.replace('name)', 'p_name)')}, 6) AS sim FROM part")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.round(trigram_similarity(F.col("name"), F.lit(NAME)), 6).alias("sim"))


@query(
    "name_search",
    f"""WITH e AS ({ENTRIES_SQL}), s AS (SELECT file_id, name, {NAME_SIM} AS sim FROM e WHERE owner_id = {OWNER} AND NOT deleted),
        c AS (SELECT file_id, name, round(CASE WHEN name = '{NAME}' THEN 1.0 WHEN name ILIKE '{NAME}%' THEN 0.75 + sim * 0.25 ELSE sim END, 9) AS score FROM s WHERE name ILIKE '%{NAME}%' OR sim > 0.1)
        SELECT * FROM c ORDER BY score DESC, file_id DESC LIMIT 20""",
)
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.name_search(entries(spark, sf_dir), search.SearchInput(NAME, "name", 20, OWNER))


@query("name_index_search", ORACLES["name_search"])
def name_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``name_search`` by trigram postings; the index is keyed by the files of its tables."""
    key = content_key(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/part.parquet")
    index = NameIndex(spark, f"{shared_dir(spark)}/names-{key}")
    if not index.exists():
        index.build(entries(spark, sf_dir))
    return index.search(search.SearchInput(NAME, "name", 20, OWNER))


@query("ann_topk")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cosine_topk`` over the vectors of the nearest cells; approximate, so there is no SQL: a test measures its recall."""
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()
    cells = VectorCells(spark, f"{shared_dir(spark)}/cells-{content_key(spark, f'{sf_dir}/embeddings.parquet')}")
    if not cells.exists():
        cells.build(vectors)
    return cells.topk(first.embedding if first else []).withColumn("score", F.round("score", 6))


KINDS = ("text/plain", "application/json")


@query(
    "scoped_search",
    f"""{PATHS_SQL}, e AS ({ENTRIES_SQL}), s AS (SELECT file_id, name, {NAME_SIM} AS sim FROM e
          WHERE NOT deleted AND mime_type IN {KINDS} AND 'n' || (file_id % 25) IN (SELECT folder_id FROM paths WHERE list_contains(path, '{SCOPE}'))),
        c AS (SELECT file_id, name, round(CASE WHEN name = '{NAME}' THEN 1.0 WHEN name ILIKE '{NAME}%' THEN 0.75 + sim * 0.25 ELSE sim END, 9) AS score FROM s WHERE name ILIKE '%{NAME}%' OR sim > 0.1)
        SELECT * FROM c ORDER BY score DESC, file_id DESC LIMIT 20""",
)
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files lie in the nations' folders; a region's folder and all below it are searched, for two MIME types."""
    filed = entries(spark, sf_dir).withColumn("folder_id", F.concat(F.lit("n"), F.pmod("file_id", F.lit(25))))
    inside = tree.scoped(filed, tree.folder_paths(folders(spark, sf_dir)), SCOPE)
    return search.name_search(inside, search.SearchInput(NAME, "name", 20, mime_types=KINDS))


MATCHED = " AND ".join(f"list_contains(terms, '{t}')" for t in TERMS.split())


def full_sql(chunks: str) -> str:
    return f"""
    chunks AS ({chunks}), status AS ({STATUS_SQL}),
    indexed AS (SELECT chunks.* FROM chunks JOIN status USING (object_id) WHERE status = 'indexed'),
    matched AS (SELECT object_id, ordinal, content, terms FROM (SELECT *, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS terms FROM indexed) WHERE {MATCHED}),
    hits AS (SELECT object_id, ordinal, p, w FROM (SELECT object_id, ordinal, generate_subscripts(terms, 1) AS p, unnest(terms) AS w FROM matched) WHERE w IN {tuple(TERMS.split())}),
    lasts AS (SELECT object_id, ordinal, p, {', '.join(f"max(CASE WHEN w = '{t}' THEN p END) OVER r AS l{i}" for i, t in enumerate(TERMS.split()))} FROM hits
              WINDOW r AS (PARTITION BY object_id, ordinal ORDER BY p)),
    ends AS (SELECT object_id, ordinal, least({', '.join(f'l{i}' for i in range(len(TERMS.split())))}) AS s, min(p) AS e FROM lasts
             WHERE {' AND '.join(f'l{i} IS NOT NULL' for i in range(len(TERMS.split())))} GROUP BY ALL),
    covers AS (SELECT c.object_id, c.ordinal, c.s, c.e, count(*) AS k FROM ends c JOIN hits h ON h.object_id = c.object_id AND h.ordinal = c.ordinal AND h.p BETWEEN c.s AND c.e GROUP BY ALL),
    density AS (SELECT object_id, ordinal, round(sum(0.1 / (1 + (e - s) - (k - 1))), 9) AS score FROM covers GROUP BY ALL)"""


FULL_SQL = full_sql(CHUNKS_SQL)


@query("fulltext_match", f"WITH {FULL_SQL} SELECT object_id, ordinal FROM matched")
def fulltext_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching_chunks(indexed_chunks(spark, sf_dir), TERMS).select("object_id", "ordinal")


@query("cover_density", f"WITH {FULL_SQL} SELECT object_id, ordinal, round(score, 6) AS score FROM density")
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cover_density(indexed_chunks(spark, sf_dir), TERMS).select("object_id", "ordinal", F.round("score", 6).alias("score"))


LIVE_SQL = f"live AS (SELECT * FROM ({ENTRIES_SQL}) WHERE owner_id = {OWNER} AND NOT deleted)"


def candidates_sql(full: str) -> str:
    return f"""{full}, {LIVE_SQL},
    full_c AS (SELECT file_id, name, ordinal, content, score FROM live JOIN density USING (object_id) JOIN indexed USING (object_id, ordinal) ORDER BY score DESC, file_id, ordinal LIMIT 80)"""


FULL_CANDIDATES = candidates_sql(FULL_SQL)
QUERY_WORDS = " UNION ALL ".join(f"SELECT 0 AS k, '{w}' AS w" for w in TERMS.split())
SEMANTIC_CANDIDATES = f"""
    q AS (SELECT bucket, sum(sign) AS v FROM ({HASHED_SQL.format(words=QUERY_WORDS)}) GROUP BY bucket),
    b AS ({HASHED_SQL.format(words="SELECT struct_pack(o := object_id, n := ordinal) AS k, unnest(regexp_split_to_array(lower(content), '[[:space:]]+')) AS w FROM indexed")}),
    cells AS (SELECT k, bucket, sum(sign) AS v FROM b GROUP BY ALL),
    norms AS (SELECT k, sqrt(sum(v * v)) AS norm FROM cells GROUP BY k HAVING norm > 0),
    cosines AS (SELECT norms.k, round(coalesce(any_value(d.dot), 0) / (any_value(norm) * (SELECT sqrt(sum(v * v)) FROM q)), 9) AS score
                FROM norms LEFT JOIN (SELECT k, sum(cells.v * q.v) AS dot FROM cells JOIN q USING (bucket) GROUP BY k) d ON norms.k = d.k GROUP BY norms.k),
    semantic_c AS (SELECT file_id, name, i.ordinal, content, score FROM live JOIN indexed i USING (object_id) JOIN cosines ON k.o = i.object_id AND k.n = i.ordinal ORDER BY score DESC, file_id, ordinal LIMIT 80)"""
SHOWN = "file_id, name, ordinal, md5(content) AS content_md5, round(score, 6) AS score"


def shown(df: DataFrame) -> DataFrame:
    return df.select("file_id", "name", "ordinal", F.md5("content").alias("content_md5"), F.round("score", 6).alias("score"))


@query("fulltext_search", f"WITH {FULL_CANDIDATES} SELECT {SHOWN} FROM full_c")
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.fulltext_candidates(entries(spark, sf_dir), indexed_chunks(spark, sf_dir), WANTED))


@query("postings_search", f"WITH {candidates_sql(full_sql(WHOLE_CHUNKS_SQL))} SELECT {SHOWN} FROM full_c")
def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``fulltext_search`` in all chunks of whole texts, from the postings of the query's three terms."""
    return shown(search_index(spark, sf_dir, most=None).fulltext_candidates(stored_entries(spark, sf_dir), WANTED))


@query("semantic_search", f"WITH {FULL_CANDIDATES}, {SEMANTIC_CANDIDATES} SELECT {SHOWN} FROM semantic_c")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.semantic_candidates(entries(spark, sf_dir), indexed_chunks(spark, sf_dir), WANTED))


@query("semantic_postings", f"WITH {FULL_CANDIDATES}, {SEMANTIC_CANDIDATES} SELECT {SHOWN} FROM semantic_c")
def semantic_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``semantic_search`` from the postings of the places where the query's vector isn't zero."""
    return shown(search_index(spark, sf_dir).semantic_candidates(stored_entries(spark, sf_dir), WANTED))


@query("semantic_versions", f"WITH {FULL_CANDIDATES}, {SEMANTIC_CANDIDATES} SELECT {SHOWN} FROM semantic_c WHERE false UNION ALL SELECT {SHOWN} FROM semantic_c")
def semantic_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index beside its rows of an older model, whose vectors differ: only those of the wanted versions are ranked."""
    chunks = indexed_chunks(spark, sf_dir)
    older = chunks.withColumns({"model_version": F.lit("m0"), "vector": F.transform("vector", lambda v: (v + 1).cast("short"))})
    wanted = search.SearchInput(TERMS, "semantic", 20, OWNER, pipeline_version=PIPELINE, model_version=MODEL)
    return shown(search.semantic_candidates(entries(spark, sf_dir), chunks.unionByName(older), wanted))


CITATION = r"{'id': file_id || ':' || ordinal, 'excerpt': substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 320)}"
HITS = "file_id, name, round(score, 6) AS score, place, list_aggregate(list_transform(citations, lambda c: c.id), 'string_agg', ',') AS citations"


def hits(df: DataFrame) -> DataFrame:
    return df.select("file_id", "name", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"), F.array_join(F.transform("citations", lambda c: c.id), ",").alias("citations"))


@query(
    "group_hits",
    f"""WITH {FULL_CANDIDATES},
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id, ordinal) AS seat FROM full_c),
        g AS (SELECT file_id, any_value(name) AS name, max(score) AS score, min(seat) AS first, list_slice(list({CITATION} ORDER BY seat), 1, 3) AS citations FROM r GROUP BY file_id ORDER BY first LIMIT 20),
        f AS (SELECT *, row_number() OVER (ORDER BY score DESC, first) AS place FROM g)
        SELECT {HITS} FROM f""",
)
def group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.SearchInput(TERMS, "fulltext", 20, OWNER)
    return hits(search.search(entries(spark, sf_dir), indexed_chunks(spark, sf_dir), wanted))


def list_sql(name: str, number: int) -> str:
    return f"""l{number} AS (SELECT file_id, {number} AS list, row_number() OVER (ORDER BY seat) AS rank, name, citation FROM (
        SELECT file_id, min(seat) AS seat, arg_min(name, seat) AS name, arg_min({CITATION}, seat) AS citation
        FROM (SELECT *, row_number() OVER (ORDER BY score DESC, file_id, ordinal) AS seat FROM {name}) GROUP BY file_id))"""


def fused_sql(limit: int) -> str:
    return f"""{FULL_CANDIDATES}, {SEMANTIC_CANDIDATES}, {list_sql("full_c", 1)}, {list_sql("semantic_c", 2)},
    u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
    m AS (SELECT file_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, arg_min(name, list) AS name, list(citation ORDER BY list) AS c FROM u GROUP BY file_id),
    fused AS (SELECT file_id, name, score, row_number() OVER (ORDER BY score DESC, file_id) AS place, CASE WHEN len(c) = 2 AND c[1].id = c[2].id THEN c[1:1] ELSE c END AS citations
              FROM m ORDER BY score DESC, file_id LIMIT {limit})"""


@query("rrf_fusion", f"WITH {fused_sql(100)} SELECT file_id, round(score, 6) AS score, place FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, index = stored_entries(spark, sf_dir), search_index(spark, sf_dir)
    both = search.fused(index.fulltext_candidates(files, WANTED), index.semantic_candidates(files, WANTED), 100)
    return both.select("file_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("hybrid_search", f"WITH {fused_sql(20)} SELECT {HITS} FROM fused")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(search_index(spark, sf_dir).search(stored_entries(spark, sf_dir), WANTED))


@query(
    "cosine_topk",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
       SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS score FROM embeddings, q
       ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 9) DESC, vec_id LIMIT 40""",
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()
    return search.cosine_topk(vectors, first.embedding if first else []).withColumn("score", F.round("score", 6))


EVIDENCE_SQL = f"""{fused_sql(40)},
    flat AS (SELECT file_id, name, place, unnest(citations[1:2]) AS c, generate_subscripts(citations[1:2], 1) AS seat FROM fused),
    evidence AS (SELECT row_number() OVER (ORDER BY place, seat) AS n, file_id, name, c.id AS citation_id, c.excerpt AS excerpt FROM flat QUALIFY n <= 8)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.SearchInput(rag.checked_question(TERMS), "hybrid", rag.SEARCH_LIMIT, OWNER)
    return rag.evidence(search_index(spark, sf_dir).search(stored_entries(spark, sf_dir), wanted))


# the search for an answer has a limit of forty files, so 160 candidates in each list
ASKED_SQL = EVIDENCE_SQL.replace("LIMIT 80", "LIMIT 160")


@query("evidence_selection", f"WITH {ASKED_SQL} SELECT n, file_id, name, citation_id, excerpt FROM evidence")
def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).withColumn("n", F.col("n").cast("long"))


ALLOWED = tuple(range(1, 200, 4))


@query("evidence_allowed", f"WITH {ASKED_SQL.replace('AS seat FROM fused)', f'AS seat FROM fused WHERE file_id IN {ALLOWED})')} SELECT n, file_id, name, citation_id, excerpt FROM evidence")
def evidence_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from fifty chosen files, which are picked after the search."""
    wanted = search.SearchInput(rag.checked_question(TERMS), "hybrid", rag.SEARCH_LIMIT, OWNER)
    found = rag.evidence(search_index(spark, sf_dir).search(stored_entries(spark, sf_dir), wanted), ALLOWED)
    return found.withColumn("n", F.col("n").cast("long"))


@query(
    "answer_assembly",
    f"""WITH {ASKED_SQL}
        SELECT coalesce('{rag.OPENING}{TERMS}{rag.CLOSING}' || chr(10) || string_agg('[' || n || '] ' || name || '：' || CASE WHEN length(excerpt) > 180 THEN substr(excerpt, 1, 180) || '...' ELSE excerpt END, chr(10) ORDER BY n), '{rag.NOTHING}') AS answer,
               count(*) > 0 AS grounded, coalesce(string_agg(citation_id, ',' ORDER BY n), '') AS citations FROM evidence""",
)
def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.answer(asked(spark, sf_dir), TERMS).withColumn("citations", F.array_join("citations", ","))


@query(
    "citation_validation",
    r"""SELECT conv_id, turn, CASE WHEN turn % 5 <> 3 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS answer, turn % 5 <> 4 AND turn <= 2 AND turn % 2 = 0 AS grounded,
              CASE WHEN turn % 5 <> 4 AND turn <= 2 AND turn % 2 = 0 THEN 'c' || turn ELSE '' END AS citations, CASE WHEN turn % 5 = 3 THEN 'empty answer' END AS error
       FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''""",
)
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as provider replies: JSON with a known, an unknown and a repeated citation, JSON without an answer, or bare text."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND trim(text) <> ''")
    own = F.concat(F.lit("c"), "turn")
    reply = F.to_json(F.struct(F.col("text").alias("answer"), (F.col("turn") % 2 == 0).alias("grounded"), F.array(own, F.lit("unknown"), own).alias("citations")))
    silent = F.to_json(F.struct(F.lit(True).alias("grounded"), F.array(own).alias("citations")))
    raw = F.when(F.col("turn") % 5 == 4, F.col("text")).when(F.col("turn") % 5 == 3, silent).otherwise(F.concat(F.lit("```json\n"), reply, F.lit("\n```")))
    checked = turns.select("conv_id", "turn", rag.validated(raw, F.array(*map(F.lit, ("c0", "c1", "c2")))).alias("v"))
    return checked.select("conv_id", "turn", "v.answer", "v.grounded", F.array_join("v.citations", ",").alias("citations"), "v.error")
