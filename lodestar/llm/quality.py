"""Quality rules of documents and of their hosts.

Failures of every rule are counted by host, and the rates are shrunk with a beta prior that is fitted
to all hosts, so that a host with few documents isn't judged by them alone. A host's verdicts go back to its
documents by a join: where a rule is broken often its failures count, elsewhere they are forgiven.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import free_names, kept_parts, per_row, slices, words, written

SYMBOLS = r"[#*$%&|<>]"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rules that a document may break and still be kept, if its host's rate allows it; with the metrics' names.
SOFT_RULES = {"symbols": "10 * n_symbols > n_words", "dup_lines": "100 * n_dup_lines > 30 * n_lines"}


def _ranked(values: np.ndarray) -> tuple[np.ndarray, int]:
    found, ranks = np.unique(values, return_inverse=True)
    return ranks.astype(np.int64), len(found)


def _repeated_words(codes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Of each row, words inside some window of ``size`` words that the row has twice or more."""
    n = len(codes)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + size <= offsets[1:][rows]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    window, base = rows[starts], int(codes.max()) + 1
    for k in range(size):  # ranks keep the key exact and below the square of the rows
        window, _ = _ranked(window * base + codes[starts + k])
    often = np.bincount(window)[window] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[often], 1)
    np.add.at(edge, starts[often] + size, -1)
    return per_row(np.cumsum(edge[:-1]) > 0, offsets)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, lines with a word that equal an earlier line, and all lines with a word."""
    offsets, lines = kept_parts(pc.split_pattern(texts, "\n"))
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    if not len(lines):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    coded = lines.dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys = rows * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    distinct = np.unique(keys[worded]) // max(1, len(coded.dictionary))
    n = np.bincount(rows[worded], minlength=len(texts))
    return n - np.bincount(distinct, minlength=len(texts)), n


def _metrics(texts: pa.Array, window: int) -> list[np.ndarray]:
    texts = pc.fill_null(texts, "")
    offsets, flat = words(texts)
    chars = per_row(pc.utf8_length(flat).to_numpy(zero_copy_only=False), offsets)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False)
    repeated, lines = _lines(texts)
    return [np.diff(offsets), chars, symbols, repeated, _repeated_words(codes, offsets, window), lines]


def text_metrics(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Columns of ``docs`` but the text, and the metrics of the whole text, with ``n_lines``, its lines with a word. Map-only; null is empty."""
    metrics = [*METRICS, "n_lines"]
    kept = docs.drop(*metrics)
    rest = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*rest, *[T.StructField(m, T.LongType()) for m in metrics]])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [pa.array(x.astype(np.int64)) for x in _metrics(batch.column(text), window)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *found], names=[*[f.name for f in rest], *metrics])

    return kept.mapInArrow(measured, schema)


def host_rates(failures: DataFrame, host: str, rules: dict[str, str]) -> DataFrame:
    """Of each host ``host_docs`` and, for every rule (name to column), ``failed_<name>`` and ``rate_<name>``, the shrunk failure rate.

    A rule's beta prior has the mean of all documents; its weight comes from the variance of the
    hosts' rates beyond binomial noise (method of moments). Without such variance, every
    host has the overall rate. Null is a host of its own.
    """
    sums = [F.sum(F.col(c).cast("long")).alias(f"failed_{r}") for r, c in rules.items()]
    hosts = failures.groupBy(host).agg(F.count("*").alias("host_docs"), *sums)
    parts = [F.sum(f"failed_{r}").alias(f"f_{r}") for r in rules] + [F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("host_docs")).alias(f"ff_{r}") for r in rules]
    whole = hosts.agg(F.sum("host_docs").alias("n"), F.count("*").alias("k"), *parts).first()
    n, k, rates = whole.n or 0, whole.k, {}
    for r in rules:
        mean = (whole[f"f_{r}"] or 0) / n if n else 0.0
        noise = mean * (1 - mean)
        between = ((whole[f"ff_{r}"] or 0.0) - n * mean * mean - noise * (k - 1)) / n if n else 0.0
        rate = F.lit(mean)
        if between > 1e-12:
            weight = max(noise / between - 1, 0.0)
            rate = (F.col(f"failed_{r}") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
        rates[f"rate_{r}"] = rate.cast("double")
    return hosts.withColumns(rates)


def quality_verdicts(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = 10, max_repeat: int = 20, max_host_rate: float = 0.5, max_soft_rate: float = 0.05) -> DataFrame:
    """Columns of ``docs`` but the text, metrics, ``base_failed``, ``rate_base``, the rates of the soft rules and ``kept``.

    A document fails with fewer than ``min_words`` words or if over ``max_repeat`` percent of
    them lie in repeated windows. One that passes is kept unless its host condemns it: the host's shrunk rate
    of failures is over ``max_host_rate``, so most of its documents fail, or the document breaks a soft rule
    (many symbols, many repeated lines) of which the host's shrunk rate is over ``max_soft_rate``. A single table or
    song of a clean host is forgiven, the same in a host full of them isn't. Texts are read once and
    never shuffled; the metrics are written to the shared folder, aggregated by host with
    partial sums (a hot host is no more work), and joined to one row per host.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rules = {"base": "base_failed"} | {r: f"soft_{r}" for r in SOFT_RULES}
    added = ["base_failed", "host_docs", "kept", *[f"{kind}_{r}" for r in rules for kind in ("failed", "rate", "soft")]]
    marks = {"base_failed": failed} | {f"soft_{r}": F.expr(rule) for r, rule in SOFT_RULES.items()}
    base = written(text_metrics(docs.drop(*added), text).withColumns(marks), "metrics")
    rates = host_rates(base, host, rules)
    of = free_names(base, "_host")[0]
    rates = rates.withColumnRenamed(host, of)
    joined = base.join(rates, base[host].eqNullSafe(rates[of]), "left").drop(of)
    condemned = F.col("rate_base") > max_host_rate
    for r in SOFT_RULES:
        condemned = condemned | (F.col(f"soft_{r}") & (F.col(f"rate_{r}") > max_soft_rate))
    return joined.withColumn("kept", ~F.col("base_failed") & ~condemned)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
     w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
     windows AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS k
                 FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
     often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
     covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM often) GROUP BY r),
     lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
     dup AS (SELECT r, count(*) - count(DISTINCT l) AS n, count(*) AS lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
     m AS (SELECT w.r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                  coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
           FROM w LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)),
     b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM m),
     u AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS f FROM
             (SELECT source, unnest([{'rule': 'base', 'failed': base_failed}, {'rule': 'symbols', 'failed': symbols}, {'rule': 'dup_lines', 'failed': dup_lines}], recursive := true) FROM b) GROUP BY ALL),
     a AS (SELECT rule, sum(n)::DOUBLE AS n, sum(f) / sum(n)::DOUBLE AS p, count(*) AS k, sum(f * f / n::DOUBLE) AS ff FROM u GROUP BY rule),
     v AS (SELECT rule, p, p * (1 - p) AS noise, (ff - n * p * p - p * (1 - p) * (k - 1)) / n AS between_hosts FROM a),
     g AS (SELECT rule, p, CASE WHEN between_hosts > 1e-12 THEN greatest(noise / between_hosts - 1, 0) END AS s FROM v),
     rates AS (SELECT source, max(rate) FILTER (rule = 'base') AS base, max(rate) FILTER (rule = 'symbols') AS symbols, max(rate) FILTER (rule = 'dup_lines') AS dup_lines FROM
                 (SELECT source, rule, CASE WHEN s IS NULL THEN p ELSE (f + p * s) / (n + s) END AS rate FROM u JOIN g USING (rule)) GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (rates.base > 0.5 OR (b.symbols AND rates.symbols > 0.05) OR (b.dup_lines AND rates.dup_lines > 0.05)) AS kept
FROM b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source
"""
