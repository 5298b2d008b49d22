"""Name, full-text, semantic and hybrid search.

Filters come before ranking, so a limit counts permitted rows only. Top-k steps are
``orderBy().limit()``, which Spark runs as bounded heaps per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import NOT_TERM, excerpt
from lodestar.functions.vectors import bucket_dot, bucket_norm, cosine, hashed_buckets, query_vector, trigram_similarity, vector_literal

MODES = ("name", "fulltext", "semantic", "hybrid")
RRF_CONSTANT, MOST_CITATIONS, NAME_LEAST = 60, 3, 0.1
MOST_QUERY_RUNES, MOST_MIME_TYPES = 1000, 20


class InvalidInput(ValueError):
    """The request breaks a limit of the contract."""

    code = "search.invalid_input"


@dataclass(frozen=True)
class SearchInput:
    query: str
    mode: str = "hybrid"
    limit: int = 20
    owner_id: int | None = None
    folders: tuple[str, ...] | None = None
    mime_types: tuple[str, ...] = ()
    pipeline_version: str | None = None
    model_version: str | None = None

    def checked(self) -> SearchInput:
        """The input with trimmed query and a limit from 1 to 100."""
        query = self.query.strip()
        if not query or len(query) > MOST_QUERY_RUNES or len(self.mime_types) > MOST_MIME_TYPES or self.mode not in MODES:
            raise InvalidInput(f"invalid search: mode {self.mode!r}, {len(query)} characters, {len(self.mime_types)} MIME types")
        limit = 20 if self.limit <= 0 else min(self.limit, 100)
        return replace(self, query=query, limit=limit)

    @property
    def candidates(self) -> int:
        return max(4 * self.limit, 40)


def permitted(entries: DataFrame, wanted: SearchInput) -> DataFrame:
    """Live entries in the scope of a search; absent conditions add no filter."""
    found = entries.filter(~F.col("deleted"))
    if wanted.owner_id is not None:
        found = found.filter(F.col("owner_id") == wanted.owner_id)
    if wanted.folders is not None:
        found = found.filter(F.col("folder_id").isin(*wanted.folders))
    if wanted.mime_types:
        found = found.filter(F.col("mime_type").isin(*wanted.mime_types))
    return found


def name_score(name: Column, query: str) -> Column:
    """1 for the name itself, 0.75 and a quarter of the similarity for a prefix, else the similarity."""
    sim = trigram_similarity(name, F.lit(query))
    return F.when(name == query, 1.0).when(name.ilike(query + "%"), 0.75 + sim * 0.25).otherwise(sim)


def name_search(entries: DataFrame, wanted: SearchInput) -> DataFrame:
    """``file_id``, ``name`` and ``score`` of names that contain the query or are similar; wildcards in the query count as such."""
    wanted = wanted.checked()
    query = wanted.query.lower()
    name = F.col("name")
    scored = permitted(entries, wanted).select("file_id", "name", F.round(name_score(name, query), 9).alias("score"), trigram_similarity(name, F.lit(query)).alias("_sim"))
    hits = scored.filter(name.ilike(f"%{query}%") | (F.col("_sim") > NAME_LEAST)).drop("_sim")
    return hits.orderBy(F.desc("score"), F.desc("file_id")).limit(wanted.candidates).orderBy(F.desc("score"), F.desc("file_id")).limit(wanted.limit)


def query_terms(query: str) -> list[str]:
    """Distinct lower-case terms of a query, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def matching_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold all terms, with ``terms``, their array of lower-case terms; an index has it already."""
    wanted = query_terms(query)
    if "terms" in chunks.columns:
        for term in wanted:
            chunks = chunks.filter(F.array_contains("terms", term))
        return chunks if wanted else chunks.limit(0)
    held = chunks.withColumn("terms", F.filter(F.split(F.lower("content"), NOT_TERM), lambda t: t != ""))
    for term in wanted:
        held = held.filter(F.lower("content").contains(term) & F.array_contains("terms", term))
    return held if wanted else held.limit(0)


def cover_density(chunks: DataFrame, query: str, keys: tuple[str, ...] = ("object_id", "ordinal")) -> DataFrame:
    """``keys`` and ``score`` of the chunks that hold all terms: a sum over minimal covers of 0.1 / (1 + noise).

    A cover is a shortest run of words with every term; noise counts its other words.
    All in array functions of one chunk: no shuffle, and memory of one chunk's positions.
    """
    wanted = query_terms(query)
    held = matching_chunks(chunks, query)
    at = F.filter(F.transform("terms", lambda t, i: F.struct(i.alias("p"), F.array_position(F.array(*map(F.lit, wanted or [""])), t).cast("int").alias("k"))), lambda x: x.k > 0)
    n = len(wanted)
    never = F.array_repeat(F.lit(-1), n)
    empty = F.struct(never.alias("last"), F.lit(-1).alias("done"), F.lit(0.0).cast("double").alias("score"), F.array().cast("array<int>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc.last, lambda v, i: F.when(i == x.k - 1, x.p).otherwise(v))
        start = F.array_min(last)
        seen = F.filter(F.array_append(acc.seen, x.p), lambda v: v >= start)
        fresh = (start >= 0) & (start > acc.done)
        noise = (x.p - start) - (F.size(seen) - 1)
        return F.struct(
            last.alias("last"),
            F.when(fresh, start).otherwise(acc.done).alias("done"),
            F.when(fresh, acc.score + F.lit(0.1) / (1 + noise)).otherwise(acc.score).alias("score"),
            seen.alias("seen"),
        )

    return held.select(*keys, F.round(F.aggregate(at, empty, step, lambda acc: acc.score), 9).alias("score"), *[c for c in ("content",) if c in held.columns])


def fulltext_candidates(entries: DataFrame, chunks: DataFrame, wanted: SearchInput) -> DataFrame:
    """Best chunks by cover density, one row per permitted file and chunk; ``chunks`` are those of indexed documents."""
    wanted = wanted.checked()
    files, mine = _scope(entries, chunks, wanted)
    return _best(files.join(cover_density(mine, wanted.query), "object_id"), wanted)


def semantic_candidates(entries: DataFrame, chunks: DataFrame, wanted: SearchInput) -> DataFrame:
    """Best chunks by cosine to the query's hashed embedding; an exact scan, and zero vectors match nothing.

    Chunks of an index (``vector``, ``norm``) are read at the query's few non-zero places; those of other
    pipeline or model versions than ``wanted`` names are left out, as their vectors can't be compared.
    """
    wanted = wanted.checked()
    for column, version in (("pipeline_version", wanted.pipeline_version), ("model_version", wanted.model_version)):
        if version is not None:
            chunks = chunks.filter(F.col(column) == version)
    if "vector" in chunks.columns:
        files, mine = _scope(entries, chunks, wanted)
        score = F.lit(0.0)
        for place, weight in enumerate(query_vector(wanted.query)):
            if weight:
                score = score + F.lit(weight) * F.get("vector", F.lit(place))
        scored = mine.select("object_id", "ordinal", "content", F.when(F.col("norm") > 0, F.round(score / F.col("norm"), 9)).alias("score"))
        return _best(files.join(scored, "object_id"), wanted).filter("score IS NOT NULL")
    # three projections, so that no array is built twice; a filter before the limit would be pushed into them
    files, mine = _scope(entries, chunks, wanted)
    coded = mine.select("object_id", "ordinal", "content", hashed_buckets(F.col("content")).alias("_codes"))
    parts = coded.select("object_id", "ordinal", "content", bucket_dot(F.col("_codes"), query_vector(wanted.query)).alias("_dot"), bucket_norm(F.col("_codes")).alias("_norm"))
    scored = parts.withColumn("score", F.when(F.col("_norm") > 0, F.round(F.col("_dot") / F.col("_norm"), 9)))
    return _best(files.join(scored, "object_id"), wanted).filter("score IS NOT NULL")


def _scope(entries: DataFrame, chunks: DataFrame, wanted: SearchInput) -> tuple[DataFrame, DataFrame]:
    """Permitted files and the chunks of their content: only those are scored. Both joins are on the object, so one shuffle serves them."""
    files = permitted(entries, wanted).select("file_id", "name", "object_id")
    return files, chunks.join(files.select("object_id"), "object_id", "left_semi")


def _best(hits: DataFrame, wanted: SearchInput) -> DataFrame:
    rows = hits.select("file_id", "name", "ordinal", "content", "score")
    return rows.orderBy(F.desc("score"), "file_id", "ordinal").limit(wanted.candidates)


def _ranked(candidates: DataFrame) -> DataFrame:
    """Numbers candidates; they are a few hundred rows at most, so one window over all is small by construction."""
    return candidates.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "file_id", "ordinal")))


def _citation() -> Column:
    return F.struct(F.concat_ws(":", "file_id", "ordinal").alias("id"), excerpt(F.col("content")).alias("excerpt"))


def group_hits(candidates: DataFrame, limit: int = 20) -> DataFrame:
    """Files of the candidates: best ``score``, up to three ``citations``, ``place`` by score and first appearance.

    The limit counts files as they first appear in the candidates' order.
    """
    ranked = _ranked(candidates)
    cited = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", _citation().alias("c")))), lambda x: x.c), 1, MOST_CITATIONS)
    files = ranked.groupBy("file_id").agg(F.max("score").alias("score"), F.min("place").alias("first"), F.first("name").alias("name"), cited.alias("citations"))
    kept = files.orderBy("first").limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first"))).select("file_id", "name", "score", "place", "citations")


def fused(fulltext: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two candidate lists by file; ``place`` by score and file id.

    Ranks count distinct files; each list adds 1 / (60 + rank) and the citation of the file's best chunk.
    """

    def files(candidates: DataFrame, number: int) -> DataFrame:
        first = F.min_by(F.struct("name", _citation().alias("c")), "place")
        best = _ranked(candidates).groupBy("file_id").agg(F.min("place").alias("at"), first.alias("b"))
        rank = F.row_number().over(Window.orderBy("at"))
        return best.select("file_id", F.lit(number).alias("list"), rank.alias("rank"), "b.name", "b.c")

    both = files(fulltext, 1).unionByName(files(semantic, 2))
    share = 1.0 / (RRF_CONSTANT + F.col("rank"))
    cited = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("list", "c"))), lambda x: x.c))
    # the sum of at most two shares is taken in list order, so equal inputs give equal scores
    score = F.coalesce(F.max(F.when(F.col("list") == 1, share)), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("list") == 2, share)), F.lit(0.0))
    merged = both.groupBy("file_id").agg(F.round(score, 12).alias("score"), F.min_by("name", "list").alias("name"), cited.alias("citations"))
    kept = merged.orderBy(F.desc("score"), "file_id").limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "file_id"))).select("file_id", "name", "score", "place", "citations")


def search(entries: DataFrame, chunks: DataFrame, wanted: SearchInput) -> DataFrame:
    """Hits of any mode: ``file_id``, ``name``, ``score``, ``place``, ``citations``."""
    wanted = wanted.checked()
    if wanted.mode == "name":
        hits = name_search(entries, wanted)
        no = F.array().cast("array<struct<id:string,excerpt:string>>")
        return hits.select("file_id", "name", "score", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("file_id"))).alias("place"), no.alias("citations"))
    if wanted.mode == "fulltext":
        return group_hits(fulltext_candidates(entries, chunks, wanted), wanted.limit)
    if wanted.mode == "semantic":
        return group_hits(semantic_candidates(entries, chunks, wanted), wanted.limit)
    return fused(fulltext_candidates(entries, chunks, wanted), semantic_candidates(entries, chunks, wanted), wanted.limit)


def as_json(hits: DataFrame) -> DataFrame:
    """Hits as one JSON object each, in ``value``, with ``place`` to order them by."""
    return hits.select("place", F.to_json(F.struct("file_id", "name", "score", "citations")).alias("value"))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 40, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest dense vectors by cosine, ties by key; an exact scan."""
    scored = vectors.select(key, F.round(cosine(F.col(vector), vector_literal(query)), 9).alias("score"))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)
