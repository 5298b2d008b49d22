"""Merkle manifest of a data set: a tree per source, a tree over the sources' roots, and an inclusion proof for every row.

A tree's nodes have coordinates: source number, level and place. Levels are built in bands: a task takes
``fan ** BAND`` neighbouring nodes, never a whole source, and makes all nodes above them in the band. The
nodes are written as a table. A proof is a lookup: every node at the bottom of a band explodes into the coordinates
of its siblings on the band's levels, which follow from its place and the size of its source, and joins
the node table; answers are ordered and concatenated. The part of a proof above a band is looked up once for a whole
block of rows and joined to them, so no node near a root is fetched row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import written

#: Levels that a band has: a block holds ``fan ** BAND`` nodes.
BAND = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the encoded values, concatenated."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("long")


def _ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows in the order given, as a written table with ``_part`` and ``_row``, the place inside the part."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", place), "ranged")


def _before(by: str | None) -> Column:
    """Rows of earlier parts: one number for each part, or each group and part; a group has no more of them than there are tasks."""
    window = Window.orderBy("_part") if by is None else Window.partitionBy(by).orderBy("_part")
    return F.coalesce(F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def height(n: Column, fan: int) -> Column:
    """Levels above the leaves: powers of ``fan`` below ``n``."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fan
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in powers]), lambda x: x < n))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (source, id, digest, salt and more) with ``no``, the number of their source (null first), ``at``, their place in it by id, and ``n``, its size.

    Places are counted in ranges of sources and ids, so a hot source is many ranges, and ``salt``
    splits equal rows.
    """
    ranged = _ranged(rows, F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("salt").asc())
    counts = ranged.groupBy("_part", "source").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    numbered = _ranged(counts.groupBy("source").agg(F.sum("_rows").alias("n")), F.col("source").asc_nulls_first())
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = sizes.select(F.col("_part").alias("_of"), _before(None).alias("_past"))
    sources = numbered.join(offsets, F.col("_part") == F.col("_of")).select(F.col("source").alias("_named"), (F.col("_past") + F.col("_row")).alias("no"), "n")
    starts = counts.withColumn("_past", _before("source")).join(sources, F.col("source").eqNullSafe(F.col("_named")))
    starts = starts.select(F.col("_part").alias("_of"), "_named", "no", "n", (F.col("_past") - F.col("_first")).alias("_past"))
    found = ranged.join(starts, (F.col("_part") == F.col("_of")) & F.col("source").eqNullSafe(F.col("_named")))
    return found.withColumn("at", F.col("_past") + F.col("_row")).drop("_part", "_row", "_of", "_named", "_past", "salt")


def _above(below: Column, fan: int) -> Column:
    """The digests of each ``fan`` neighbours."""
    starts = F.sequence(F.lit(1), F.size(below), F.lit(fan))
    return F.transform(starts, lambda i: F.unhex(F.sha2(_joined(F.slice(below, i, F.lit(fan))), 256)))


def _band(base: DataFrame, level: int, fan: int, band: int) -> DataFrame:
    """Nodes on the ``band`` levels above the nodes ``base`` of ``level``, as far as each source's tree goes."""
    block = _div(F.col("at"), fan**band)
    found = base.groupBy("no", block.alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("l0"))
    found = found.withColumn("l0", F.col("l0.digest"))
    for k in range(1, band + 1):
        found = found.withColumn(f"l{k}", _above(F.col(f"l{k - 1}"), fan))
    levels = [F.struct(F.lit(level + k).alias("level"), F.lit(fan ** (band - k)).cast("long").alias("wide"), F.col(f"l{k}").alias("digests")) for k in range(1, band + 1)]
    one = found.select("no", "n", "block", F.explode(F.array(*levels)).alias("x")).filter(F.col("x.level") <= height(F.col("n"), fan))
    each = one.select("no", "n", "x.level", (F.col("block") * F.col("x.wide")).alias("first"), F.posexplode("x.digests").alias("pos", "digest"))
    return each.select("no", "n", "level", (F.col("first") + F.col("pos")).alias("at"), "digest")


def _run(n: Column, at: Column, level: int, k: int, fan: int) -> Column:
    """The siblings ``k`` levels up; null from the root on."""
    own, count = _div(at, fan**k), _div(n + (fan ** (level + k) - 1), fan ** (level + k))
    first = _div(own, fan) * fan
    others = F.filter(F.sequence(first, F.least(first + (fan - 1), count - 1)), lambda i: i != own)
    found = F.transform(others, lambda i: F.struct(F.lit(level + k).alias("level"), i.alias("sibling"), (i < own).alias("left")))
    return F.when(F.lit(level + k) < F.col("high"), found)


def _siblings(base: DataFrame, level: int, fan: int, band: int) -> DataFrame:
    """Of each node of ``base`` the coordinates of its siblings on its level and those above it in the band."""
    runs = [_run(F.col("n"), F.col("at"), level, k, fan) for k in range(band)]
    high = base.withColumn("high", height(F.col("n"), fan)).withColumn("high", F.when(F.col("high") > level, F.col("high")).otherwise(0))
    asked = F.explode(F.concat(*[F.coalesce(r, F.array().cast("array<struct<level:int,sibling:bigint,left:boolean>>")) for r in runs]))
    return high.filter("high > 0").select("no", "at", asked.alias("x")).select("no", "at", "x.level", "x.sibling", "x.left")


def _steps(level: int, band: int, fan: int) -> Column:
    """What stands before and after the own digest on each level of the band, from the ordered answers ``told``."""
    top = F.least(height(F.col("n"), fan), F.lit(level + band))

    def side(l: Column, left: bool) -> Column:
        some = F.filter("told", lambda x: (x["level"] == l) & (x["left"] == F.lit(left)))
        return _joined(F.transform(some, lambda x: x["digest"]))

    levels = F.when(top > level, F.sequence(F.lit(level), top - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(levels, lambda l: F.struct(side(l, True).alias("before"), side(l, False).alias("after")))


def tree(leaves: DataFrame, fan: int, band: int) -> list[DataFrame]:
    """The written node tables: ``leaves`` (no, n, level 0, at, digest), then a table per band, to the highest root."""
    tables, level = [leaves], 0
    while True:
        high = tables[-1].agg(F.max(height(F.col("n"), fan))).first()[0]
        if high is None or high <= level:
            return tables
        base = tables[-1].filter(F.col("level") == level).filter(height(F.col("n"), fan) > level)
        tables.append(written(_band(base, level, fan, band), "nodes"))
        level += band


def tree_roots(tables: list[DataFrame], fan: int) -> DataFrame:
    """``no`` and ``root`` of each tree."""
    found = [t.filter(F.col("level") == height(F.col("n"), fan)).select("no", F.col("digest").alias("root")) for t in tables]
    return reduce(DataFrame.unionByName, found)


def _told(tables: list[DataFrame], b: int, fan: int, band: int, own: DataFrame, names: list[str]) -> DataFrame:
    """Of each node at the bottom of band ``b``: ``no``, ``block``, ``at``, ``n``, its columns ``names`` and its ``steps`` on the band's levels."""
    level = b * band
    base = own.select("no", "n", "at")
    asked = _siblings(base, level, fan, band)
    nodes = tables[b].unionByName(tables[b + 1]) if b + 1 < len(tables) else tables[b]
    nodes = nodes.filter((F.col("level") >= level) & (F.col("level") < level + band)).select(F.col("no").alias("_no"), F.col("level").alias("_level"), F.col("at").alias("_at"), "digest")
    answers = asked.join(nodes, (F.col("no") == F.col("_no")) & (F.col("level") == F.col("_level")) & (F.col("sibling") == F.col("_at")))
    answers = answers.select("no", "at", F.struct("level", "sibling", "left", "digest").alias("x"))
    both = answers.unionByName(own.select("no", "at", F.lit(True).alias("own"), "n", *names), allowMissingColumns=True)
    block = _div(F.col("at"), fan**band)
    # a block's rows lie together: they are grouped here and joined with what stands above the block next, without another shuffle
    both = both.withColumn("block", block).repartition("no", "block")
    kept = [F.max(c).alias(c) for c in ("n", *names)]
    found = both.groupBy("no", "block", "at").agg(F.array_sort(F.collect_list("x")).alias("told"), *kept)
    return found.withColumn("steps", _steps(level, band, fan)).drop("told")


def paths(tables: list[DataFrame], own: DataFrame, names: list[str], tails: DataFrame, fan: int, band: int) -> DataFrame:
    """``own`` (no, n, at and ``names``: the leaves) with ``steps`` up to the root, and with the columns of ``tails``.

    ``tails`` has a row for each tree: ``no``, ``n``, ``steps`` beyond its root, and what else all of its leaves get.
    """
    more = [c for c in tails.columns if c not in ("no", "n", "steps")]
    ends = tails.withColumn("bands", F.greatest(F.ceil(height(F.col("n"), fan) / F.lit(band)), F.lit(1)))
    above = None
    for b in range(max(1, len(tables) - 1) - 1, -1, -1):
        last = ends.filter(F.col("bands") == b + 1).select("no", F.lit(0).cast("long").alias("block"), F.col("steps").alias("rest"), *more)
        above = last if above is None else last.unionByName(above)
        nodes = own if b == 0 else tables[b].filter(F.col("level") == b * band)
        if b:  # a tree that ends with the band below asks nothing here
            nodes = nodes.filter(height(F.col("n"), fan) > b * band)
        found = _told(tables, b, fan, band, nodes, names if b == 0 else [])
        found = found.join(above, ["no", "block"]).withColumn("steps", F.concat("steps", "rest")).drop("rest")
        if b == 0:
            return found
        above = written(found.select("no", F.col("at").alias("block"), F.col("steps").alias("rest"), *more), "tails")
    raise AssertionError


def merkle_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", source: str = "source", tampered: dict[str, Column] | None = None, fan: int = 3, band: int = BAND) -> DataFrame:
    """Of each row: id, ``leaf``, ``subroot``, ``root``, ``proof``, ``proof_sha256``, ``folded_root`` and ``verified``.

    A leaf is the SHA-256 of the encoded ``fields``. In a source leaves ascend by id (null first; rows of one id by leaf),
    ``fan`` neighbours become a node until one is left, and the sources' roots, null first, then bytewise, become one root the same
    way. ``proof`` lists for each level what stands before and after the own digest, in hex. ``tampered``
    replaces fields by expressions (over columns of ``docs``) in the leaf that is folded along the untampered siblings;
    ``verified`` says whether that gives the root. Nulls are ordinary values, repeated rows have a proof each,
    an empty table gives no rows. Other columns play no part, whatever their names.
    """
    def col(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    values = {f: col(f) for f in fields}
    changed = {**values, **(tampered or {})}
    digest, other = leaf_digest(*values.values()), leaf_digest(*changed.values())
    rows = docs.select(col(id_column).alias("id"), col(source).cast("string").alias("source"), F.unhex(digest).alias("digest"), F.unhex(other).alias("other"))
    leaves = written(placed(written(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")), "placed")
    level_0 = leaves.select("no", "n", F.lit(0).alias("level"), "at", "digest")
    tables = tree(level_0, fan, band)
    subroots = tree_roots(tables, fan)
    sizes = leaves.filter("at = 0").select(F.col("no").alias("_no"), "n")
    forest = written(subroots.join(sizes, F.col("no") == F.col("_no")).select("no", "n", "root"), "subroots")
    count = forest.count()
    tops = forest.select(F.lit(0).cast("long").alias("no"), F.lit(count).cast("long").alias("n"), F.lit(0).alias("level"), F.col("no").alias("at"), F.col("root").alias("digest"))
    top_tables = tree(tops, fan, band)
    whole = tree_roots(top_tables, fan).first()
    root = whole["root"].hex() if whole else None
    none = F.array().cast("array<struct<before:string,after:string>>")
    end = docs.sparkSession.createDataFrame([(0, count)], "no long, n long").withColumn("steps", none)
    up = paths(top_tables, tops, ["digest"], end, fan, band)
    beyond = up.select(F.col("at").alias("_no"), "steps", F.col("digest").alias("subroot"))
    tails = written(forest.select("no", "n").join(beyond, F.col("no") == F.col("_no")).drop("_no"), "forest")
    found = paths(tables, leaves, ["id", "digest", "other"], tails, fan, band)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("steps", _hex(F.col("other")), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
    out = found.select(F.col("id").alias(id_column), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"), F.col("steps").alias("proof"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text(text: str = "text", id_column: str = "doc_id") -> Column:
    """Where two divides the CRC-32 of the id in decimals, the text without its line feeds."""
    even = F.crc32(F.col(id_column).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def _oracle(levels: int = 12, above: int = 6) -> str:
    """SQL of the manifest: every level of the trees is a step of its own, for up to ``3 ** levels`` rows a source and ``3 ** above`` sources."""

    def enc(value: str) -> str:
        return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"

    def climbed(prefix: str, key: str, n: int) -> str:
        out = ""
        for k in range(n):
            out += f""", {prefix}r{k} AS (SELECT {key}, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM {prefix}l{k} WHERE cnt > 1 GROUP BY ALL)
, {prefix}l{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS cnt FROM (SELECT {key}, run AS pos, sha256(array_to_string(ds, '')) AS d FROM {prefix}r{k}))"""
        return out

    def folded(prefix: str, key: str, n: int, first: str) -> str:
        out = f", {prefix}s0 AS ({first})"
        for k in range(n):
            before, after = "array_to_string(ds[1:(s.pos % 3)::BIGINT], '')", "array_to_string(ds[(s.pos % 3)::BIGINT + 2:], '')"
            out += f""", {prefix}s{k + 1} AS (SELECT s.* EXCLUDE (pos, cur, proof), s.pos // 3 AS pos,
  CASE WHEN ds IS NULL THEN cur ELSE sha256({before} || cur || {after}) END AS cur, CASE WHEN ds IS NULL THEN proof ELSE proof || {before} || {after} END AS proof
  FROM {prefix}s{k} s LEFT JOIN {prefix}r{k} r ON s.{key} IS NOT DISTINCT FROM r.{key} AND s.pos // 3 = r.run)"""
        return out

    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    fields = " || ".join(enc(f) for f in FIELDS)
    other = " || ".join(enc(f if f != "text" else f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END") for f in FIELDS)
    return f"""
WITH rows AS (SELECT doc_id, source, sha256({fields}) AS leaf, sha256({other}) AS other FROM documents)
, leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS cnt FROM rows)
, al0 AS (SELECT source, pos, leaf AS d, cnt FROM leaves){climbed("a", "source", levels)}
, subs AS ({" UNION ALL ".join(f"SELECT source, d FROM al{k} WHERE cnt = 1" for k in range(levels + 1))})
, bl0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, d, count(*) OVER () AS cnt, source FROM subs){climbed("b", "one", above)}
, top AS ({" UNION ALL ".join(f"SELECT d AS root FROM bl{k} WHERE cnt = 1" for k in range(above + 1))})
{folded("a", "source", levels, "SELECT doc_id, source, leaf, pos, other AS cur, '' AS proof FROM leaves")}
{folded("b", "one", above, f"SELECT s.doc_id, s.leaf, b.d AS subroot, 0 AS one, b.pos, s.cur, s.proof FROM as{levels} s JOIN bl0 b ON s.source IS NOT DISTINCT FROM b.source")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM bs{above}, top
"""


ORACLE = _oracle()
