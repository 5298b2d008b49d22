"""URL filter lists over time, in DataFrame operations only.

Dated entries of a list become validity intervals; each capture is evaluated
by an as-of join against the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import free_names


def _located(url: Column) -> tuple[Column, Column]:
    """Lower-case host without port or credentials, and the path with its leading slash."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^.*@|\.?:\d*$|\.$", ""))
    return host, F.regexp_extract(rest, r"^[^/]*(/.*)$", 1)


def url_keys(url: Column) -> Column:
    """What a list entry can name of a URL: its host, the parent domains of two labels or more, and host with path prefixes.

    Domain keys look like ``example.com``, path keys like ``example.com/en/``. Null for null.
    """
    host, path = _located(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when(
        host == "", F.array().cast("array<string>")
    ).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    whole = F.when((host == "") | (path == ""), F.array().cast("array<string>")).otherwise(folders)
    return F.array_distinct(F.concat(domains, whole))


def list_intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated entries (``pattern``, ``effective``, ``action``: block, allow or remove).

    A pattern names a host, or a host and a path: a folder with its slash at the end, or one page. Hosts are
    compared in lower case and paths as they are; scheme, credentials, port, query and fragment of a pattern are dropped.
    An entry holds from ``effective`` until the next entry of its pattern; ``valid_to`` is null
    for the last. Of entries at the same time block comes before allow and allow before
    remove. Entries without pattern or time are void. Repeated entries are merged before
    anything is grouped by pattern.
    """
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    host, path = _located(F.col("pattern"))
    valid = entries.filter("pattern IS NOT NULL AND effective IS NOT NULL").withColumn("pattern", F.concat(host, path)).filter("pattern <> '' AND pattern NOT LIKE '/%'")
    moments = valid.groupBy("pattern", "effective").agg(F.max(rank).alias("_rank"))
    following = F.lead("effective").over(Window.partitionBy("pattern").orderBy("effective"))
    held = moments.withColumn("valid_to", following).filter("_rank > 0")
    return held.select("pattern", F.col("effective").alias("valid_from"), "valid_to", F.when(F.col("_rank") == 2, "block").otherwise("allow").alias("action"))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, ``pattern`` and ``valid_from`` of the entry that decided.

    The longest pattern active at fetch time decides, be it block or allow; without one, or
    for a null URL or time, the capture isn't blocked and the rest is null. Equal captures are
    evaluated once, so a hot page is one row; the keys of a hot host are the probe side of an
    equi-join whose other side has the few intervals of a pattern, which never overlap: a
    key matches at most once. Columns of these names in ``captures`` are replaced.
    """
    kept = captures.drop("blocked", "pattern", "valid_from")
    at_url, at_time, at_key, at_best = free_names(kept, "_url", "_at", "_key", "_best")
    probes = kept.select(F.col(url).alias(at_url), F.col(fetched).alias(at_time)).filter(F.col(at_url).isNotNull() & F.col(at_time).isNotNull()).distinct()
    keys = probes.withColumn(at_key, F.explode(url_keys(F.col(at_url))))
    spans = list_intervals(entries)
    active = (F.col(at_time) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at_time) < F.col("valid_to")))
    hits = keys.join(spans, (keys[at_key] == spans["pattern"]) & active)
    best = F.max_by(F.struct("action", "pattern", "valid_from"), F.struct(F.length("pattern"), "pattern"))
    decided = hits.groupBy(at_url, at_time).agg(best.alias(at_best))
    joined = kept.join(decided, (kept[url] == decided[at_url]) & (kept[fetched] == decided[at_time]), "left")
    return joined.select(
        *[kept["`" + c.replace("`", "``") + "`"] for c in kept.columns],
        F.coalesce(F.col(f"{at_best}.action") == "block", F.lit(False)).alias("blocked"),
        F.col(f"{at_best}.pattern").alias("pattern"),
        F.col(f"{at_best}.valid_from").alias("valid_from"),
    )


def _digits(name: Column) -> Column:
    """A number from 0 to 2^28 - 1 that any engine derives from a string: seven digits of its MD5."""
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long")


def captures_of(pages: DataFrame, days: int = 366) -> DataFrame:
    """Pages as captures: as the table has no times, a page's fetch day is a hash of its id."""
    day = F.pmod(F.col("page_id") * 37, F.lit(days)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, by rule, as the tables have none.

    By hash, a third of the hosts is blocked at some day, half of these removed 40 days
    later and blocked again 60 days after that; a quarter of all has the folder ``/en/``
    allowed from some day on; and the parent domain of a tenth is blocked late in the year. A fifth is listed in
    capitals, with scheme, port and a query, for its folder ``/de/``, and a seventh for a folder ``/EN/``, which isn't ``/en/``.
    """
    host, _ = _located(F.col("url"))
    hosts = pages.filter("url IS NOT NULL").select(host.alias("host")).distinct().filter("host <> ''").withColumn("k", _digits(F.col("host")))
    at = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))
    day = F.pmod("k", F.lit(200))
    entry = lambda when, pattern, days, action: F.when(when, F.struct(pattern.alias("pattern"), at(days).alias("effective"), F.lit(action).alias("action")))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    rows = F.array(
        entry(F.col("k") % 3 == 0, F.col("host"), day, "block"),
        entry(F.col("k") % 6 == 0, F.col("host"), day + 40, "remove"),
        entry(F.col("k") % 6 == 0, F.col("host"), day + 100, "block"),
        entry(F.col("k") % 4 == 0, F.concat("host", F.lit("/en/")), day + 20, "allow"),
        entry(F.col("k") % 10 == 0, parent, F.lit(330), "block"),
        entry(F.col("k") % 5 == 0, F.concat(F.lit("HTTPS://"), F.upper("host"), F.lit(":443/de/?from=list")), day + 5, "block"),
        entry(F.col("k") % 7 == 0, F.concat("host", F.lit("/EN/")), day, "block"),
    )
    return hosts.select(F.explode(F.filter(rows, lambda e: e.isNotNull())).alias("e")).select("e.*")


ORACLE = r"""
WITH located AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetched_at,
         regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS rest FROM pages),
     c AS (SELECT *, lower(regexp_extract(rest, '^([^/]*)', 1)) AS host, regexp_extract(rest, '^[^/]*(/.*)$', 1) AS path FROM located),
     hosts AS (SELECT host, k, k % 200 AS day FROM (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS k FROM c WHERE host <> '')),
     entries AS (
       SELECT host AS pattern, day AS d, 2 AS rank FROM hosts WHERE k % 3 = 0
       UNION ALL SELECT host, day + 40, 0 FROM hosts WHERE k % 6 = 0
       UNION ALL SELECT host, day + 100, 2 FROM hosts WHERE k % 6 = 0
       UNION ALL SELECT host || '/en/', day + 20, 1 FROM hosts WHERE k % 4 = 0
       UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 330, 2 FROM hosts WHERE k % 10 = 0
       UNION ALL SELECT host || '/de/', day + 5, 2 FROM hosts WHERE k % 5 = 0
       UNION ALL SELECT host || '/EN/', day, 2 FROM hosts WHERE k % 7 = 0),
     moments AS (SELECT pattern, DATE '2024-01-01' + d::INT AS effective, max(rank) AS rank FROM entries GROUP BY ALL),
     spans AS (SELECT *, lead(effective) OVER (PARTITION BY pattern ORDER BY effective) AS valid_to FROM moments),
     hits AS (SELECT c.page_id, s.pattern, s.effective, s.rank FROM c JOIN spans s
              ON s.rank > 0 AND c.fetched_at >= s.effective AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
              AND (CASE WHEN contains(s.pattern, '/') THEN starts_with(c.host || c.path, s.pattern)
                   ELSE c.host = s.pattern OR (contains(s.pattern, '.') AND ends_with(c.host, '.' || s.pattern)) END)),
     best AS (SELECT page_id, arg_max(struct_pack(p := pattern, f := effective, r := rank), (length(pattern), pattern)) AS b FROM hits GROUP BY page_id)
SELECT c.page_id, c.fetched_at, coalesce(b.r = 2, false) AS blocked, b.p AS pattern, b.f AS valid_from
FROM c LEFT JOIN best USING (page_id)
"""
