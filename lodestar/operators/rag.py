"""Evidence, offline answers and checked citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import ANSWER_RUNES, collapsed, null_if_blank, prefix, stripped
from lodestar.operators.search import InvalidInput

MOST_QUESTION_RUNES, SEARCH_LIMIT, PER_FILE, MOST_EVIDENCE, MOST_FILES = 2000, 40, 2, 8, 50
# The offline provider's sentences.
NOTHING = "没有在当前网盘的授权文件中找到可用于回答的内容。"
OPENING, CLOSING = "根据网盘中的相关内容，", " 可参考以下信息："


def checked_question(question: str) -> str:
    question = question.strip()
    if not question or len(question) > MOST_QUESTION_RUNES:
        raise InvalidInput("a question has 1 to 2000 characters")
    return question


def evidence(hits: DataFrame, allowed: tuple[int, ...] = ()) -> DataFrame:
    """The first citations of hits (file_id, name, place, citations): two per file and eight in all, numbered in ``n``.

    ``allowed``, of fifty files at most, restricts the files after the search, as the product does.
    Hits are at most forty rows.
    """
    if len(allowed) > MOST_FILES:
        raise InvalidInput(f"a question names at most {MOST_FILES} files, not {len(allowed)}")
    kept = hits.filter(F.col("file_id").isin(*allowed)) if allowed else hits
    cited = kept.select("file_id", "name", "place", F.posexplode(F.slice("citations", 1, PER_FILE)).alias("at", "c")).filter("c.id <> ''")
    n = F.row_number().over(Window.orderBy("place", "at"))
    return cited.withColumn("n", n).filter(F.col("n") <= MOST_EVIDENCE).select("n", "file_id", "name", F.col("c.id").alias("citation_id"), "c.excerpt")


def answer(found: DataFrame, question: str) -> DataFrame:
    """One row: the offline ``answer`` from the evidence, ``grounded`` and the ``citations`` it rests on."""
    text = collapsed(F.col("excerpt"))
    line = F.concat(F.lit("["), F.col("n"), F.lit("] "), "name", F.lit("："), F.when(F.length(text) > ANSWER_RUNES, F.concat(prefix(text, ANSWER_RUNES), F.lit("..."))).otherwise(text))
    rows = found.select(F.struct("n", line.alias("line"), "citation_id").alias("x"))
    whole = rows.agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.concat(F.lit(OPENING + question + CLOSING + "\n"), F.array_join(F.transform("x", lambda x: x.line), "\n"))
    return whole.select(
        F.when(F.size("x") > 0, body).otherwise(NOTHING).alias("answer"),
        (F.size("x") > 0).alias("grounded"),
        F.transform("x", lambda x: x.citation_id).alias("citations"),
    )


def validated(raw: Column, allowed: Column) -> Column:
    """A struct (answer, grounded, citations, error) of a provider's raw reply.

    A reply that is no JSON object of the agreed types is an ungrounded answer as it stands. Citations outside of
    ``allowed`` and repeated ones go; without any left, or if the reply says so, the answer is ungrounded and has none.
    JSON whose answer is missing or blank is an ``error``, with no answer.
    """
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(raw), "^```json", ""), "```$", ""))
    parsed = F.from_json(bare, "answer string, grounded boolean, citations array<string>", {"mode": "PERMISSIVE"})
    value = F.try_parse_json(bare)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))
    typed = kind("$.answer").isin("STRING", "VOID") & kind("$.grounded").isin("BOOLEAN", "VOID") & kind("$.citations").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    is_json = F.coalesce(F.schema_of_variant(value).startswith("OBJECT") & typed, F.lit(False)) | (bare == "null")
    said = null_if_blank(parsed.answer)
    cited = F.array_distinct(F.filter(F.coalesce(parsed.citations, F.array().cast("array<string>")), lambda c: F.array_contains(allowed, c)))
    grounded = is_json & said.isNotNull() & F.coalesce(parsed.grounded, F.lit(False)) & (F.size(cited) > 0)
    return F.struct(
        F.when(is_json, said).otherwise(bare).alias("answer"),
        grounded.alias("grounded"),
        F.when(grounded, cited).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.when(is_json & said.isNull(), "empty answer").alias("error"),
    )
