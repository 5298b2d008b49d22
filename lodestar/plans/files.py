"""Folders, files, objects and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.functions.keys import fitted_edges, object_path, scaled_edges
from lodestar.operators import objects as op
from lodestar.operators import tree
from lodestar.plans.registry import query
from lodestar.sources.drive import ENTRIES_SQL, FOLDERS_SQL, STATUS_SQL, document_status, entries, folders, objects, table

PATHS_SQL = f"""WITH RECURSIVE f AS ({FOLDERS_SQL}),
    paths AS (SELECT folder_id, [folder_id] AS path FROM f WHERE parent_id IS NULL
              UNION ALL SELECT f.folder_id, list_append(paths.path, f.folder_id) FROM f JOIN paths ON f.parent_id = paths.folder_id)"""
E_SQL = f"WITH e AS ({ENTRIES_SQL})"
SCOPE = "r1"


@query("subtree_scope", f"{PATHS_SQL} SELECT folder_id, (len(path) - 1)::INT AS depth FROM paths WHERE list_contains(path, '{SCOPE}')")
def subtree_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree(tree.folder_paths(folders(spark, sf_dir)), SCOPE).select("folder_id", "depth")


@query(
    "breadcrumb",
    f"""{PATHS_SQL} SELECT s.folder_id, s.depth::INT AS depth, s.ancestor_id, f.name FROM
        (SELECT folder_id, unnest(path) AS ancestor_id, generate_subscripts(path, 1) - 1 AS depth FROM paths) s JOIN f ON f.folder_id = s.ancestor_id""",
)
def breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree_rows = folders(spark, sf_dir)
    return tree.breadcrumb(tree.folder_paths(tree_rows), tree_rows)


CYCLES_SQL = f"""{PATHS_SQL}, m AS (SELECT 'n' || CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE s_suppkey % 25 END AS folder_id, 's' || s_suppkey AS target_id FROM supplier UNION ALL SELECT 'r0', 'nowhere')
    SELECT m.folder_id, m.target_id, CASE WHEN p.path IS NULL THEN 'not_found' WHEN list_contains(p.path, m.folder_id) THEN 'cycle' ELSE 'ok' END AS verdict
    FROM m LEFT JOIN paths p ON p.folder_id = m.target_id"""


@query("cycle_check", CYCLES_SQL)
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.move_verdicts(moves(spark, sf_dir), tree.folder_paths(folders(spark, sf_dir)))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's folder moved below each supplier's: its own nation's, or one by the supplier's number."""
    nation = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).otherwise(F.col("s_suppkey") % 25)
    asked = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), nation).alias("folder_id"), F.concat(F.lit("s"), "s_suppkey").alias("target_id"))
    return asked.unionByName(spark.range(1).select(F.lit("r0").alias("folder_id"), F.lit("nowhere").alias("target_id")))


@query("interval_scope", f"{PATHS_SQL} SELECT folder_id, (len(path) - 1)::INT AS depth FROM paths WHERE list_contains(path, '{SCOPE}')")
def interval_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``subtree_scope`` by a range of preorder numbers."""
    return tree.interval_scope(tree.interval_labels(folders(spark, sf_dir)), SCOPE).select("folder_id", "depth")


@query("interval_cycles", CYCLES_SQL)
def interval_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``cycle_check`` by interval tests."""
    return tree.interval_moves(moves(spark, sf_dir), tree.interval_labels(folders(spark, sf_dir)))


@query(
    "interval_labels",
    f"""{PATHS_SQL}, p AS (SELECT folder_id, path FROM paths)
        SELECT a.folder_id, (len(a.path) - 1)::INT AS depth, (SELECT count(*) FROM p b WHERE b.path < a.path) AS pre, (SELECT count(*) FROM p b WHERE list_contains(b.path, a.folder_id)) AS size FROM p a""",
)
def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.interval_labels(folders(spark, sf_dir)).select("folder_id", "depth", "pre", "size")


@query(
    "folder_children",
    f"""WITH f AS ({FOLDERS_SQL}), e AS ({ENTRIES_SQL}) SELECT parent_id, 0 AS kind, folder_id AS id, name FROM f WHERE parent_id IS NOT NULL
        UNION ALL SELECT folder_id, 1, file_id::VARCHAR, name FROM e WHERE NOT deleted""",
)
def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(folders(spark, sf_dir), entries(spark, sf_dir).filter("NOT deleted"))


@query(
    "empty_folders",
    f"""WITH f AS ({FOLDERS_SQL}) SELECT folder_id FROM f WHERE folder_id NOT IN (SELECT parent_id FROM f WHERE parent_id IS NOT NULL)""",
)
def empty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that may be deleted: nothing lies in them."""
    rows = folders(spark, sf_dir)
    held = tree.children(rows, entries(spark, sf_dir).filter("NOT deleted")).select(F.col("parent_id").alias("folder_id"))
    return rows.join(held, "folder_id", "left_anti").select("folder_id")


CANONICAL = "first_value(file_id) OVER w AS canonical_id, row_number() OVER w AS position FROM e WHERE NOT deleted WINDOW w AS (PARTITION BY owner_id, object_id ORDER BY file_id)"


@query("dedup_canonical", f"{E_SQL} SELECT file_id, owner_id, {CANONICAL}")
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.canonical(entries(spark, sf_dir)).select("file_id", "owner_id", "canonical_id", F.col("position").cast("long").alias("position"))


@query("reference_count", f"{E_SQL} SELECT object_id, any_value(size_bytes) AS size_bytes, count(*) FILTER (NOT deleted) AS \"references\" FROM e GROUP BY object_id")
def reference_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reference_counts(objects(spark, sf_dir), entries(spark, sf_dir))


@query("gc_candidates", f"{E_SQL} SELECT object_id, any_value(size_bytes) AS size_bytes, 'objects/sha256/' || substr(object_id, 1, 2) || '/' || object_id AS object_key FROM e GROUP BY object_id HAVING bool_and(deleted)")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.garbage(objects(spark, sf_dir), entries(spark, sf_dir)).withColumn("object_key", object_path(F.col("object_id")))


@query("released_bytes", f"{E_SQL}, c AS (SELECT owner_id, size_bytes, {CANONICAL}) SELECT owner_id, sum(size_bytes)::BIGINT AS released_bytes, count(*) AS entries FROM c WHERE position > 1 GROUP BY owner_id")
def released_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.released_bytes(entries(spark, sf_dir))


@query(
    "dedup_migration",
    f"""{E_SQL}, c AS (SELECT file_id, {CANONICAL}) SELECT e.file_id, e.owner_id, e.object_id, coalesce(c.canonical_id, e.file_id) AS canonical_id, e.deleted OR coalesce(c.position > 1, false) AS deleted
        FROM e LEFT JOIN c USING (file_id)""",
)
def dedup_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.deduplicated(entries(spark, sf_dir))


@query("owned_objects", f"{E_SQL} SELECT DISTINCT object_id, size_bytes FROM e WHERE NOT deleted AND owner_id = 1")
def owned_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.visible_objects(objects(spark, sf_dir), entries(spark, sf_dir), 1).select("object_id", "size_bytes")


@query("file_view", f"{E_SQL}, s AS ({STATUS_SQL}) SELECT file_id, owner_id, folder_id, name, size_bytes, mime_type, status FROM e LEFT JOIN s USING (object_id) WHERE NOT deleted")
def file_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.file_view(entries(spark, sf_dir), objects(spark, sf_dir), document_status(spark, sf_dir))


@query(
    "mime_dispatch",
    f"""{E_SQL} SELECT file_id, CASE WHEN mime_type = 'text/html' THEN 'unsupported' ELSE 'text' END AS extractor,
               CASE WHEN mime_type LIKE 'text/%' THEN 'text' ELSE 'unsupported' END AS preview FROM e""",
)
def mime_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("file_id", text.extractor(F.col("mime_type")).alias("extractor"), text.preview_kind(F.col("mime_type")).alias("preview"))


FALLBACK = ("main.cpp", "Dockerfile", "photo.RAW", "notes.tar.gz", "src/App.VUE", "go.sum", "x", ".env")


@query(
    "source_fallback",
    f"""SELECT page_id, name, CASE WHEN name IN ('main.cpp', 'Dockerfile', 'src/App.VUE', 'go.sum', '.env') THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type
        FROM (SELECT page_id, {list(FALLBACK)}[page_id % 8 + 1] AS name FROM pages)""",
)
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, FALLBACK)), F.pmod("page_id", F.lit(8)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("mime_type", text.effective_mime(F.lit("application/octet-stream"), F.col("name")))


@query(
    "name_validation",
    """SELECT c_custkey, name, trim(name) NOT IN ('', '.', '..') AND NOT contains(name, '/') AND strlen(trim(name)) <= 255 AS valid
       FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN '  ' WHEN 2 THEN '..' WHEN 3 THEN 'a/' || c_name WHEN 4 THEN repeat('é', 128) ELSE ' ' || c_name || ' ' END AS name FROM customer)""",
)
def name_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 6
    name = F.when(kind == 0, F.col("c_name")).when(kind == 1, "  ").when(kind == 2, "..").when(kind == 3, F.concat(F.lit("a/"), "c_name")).when(kind == 4, F.repeat(F.lit("é"), 128)).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).withColumn("valid", text.valid_name(F.col("name")))


@query(
    "human_sizes",
    """SELECT o_orderkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', floor(s / 1024.0 * 10 + 0.5) / 10) WHEN s < 1073741824 THEN printf('%.1f MB', floor(s / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.2f GB', floor(s / 1073741824.0 * 100 + 0.5) / 100) END AS size
       FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37)::BIGINT AS s FROM orders)""",
)
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return table(spark, sf_dir, "orders").select("o_orderkey", text.human_size(size).alias("size"))


@query(
    "scaled_edges",
    """SELECT p_partkey, CASE WHEN greatest(w, h) <= 1600 THEN w ELSE greatest(1, w * 1600 // greatest(w, h)) END::BIGINT AS width, CASE WHEN greatest(w, h) <= 1600 THEN h ELSE greatest(1, h * 1600 // greatest(w, h)) END::BIGINT AS height
       FROM (SELECT p_partkey, (p_partkey * 7 + 1) AS w, (p_size * 50) AS h FROM part)""",
)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = scaled_edges(F.col("p_partkey") * 7 + 1, F.col("p_size").cast("long") * 50, 1600)
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


@query(
    "thumbnail_edges",
    """WITH s AS (SELECT p_partkey, p_partkey * 7 + 1 AS w, p_size * 50 - 50 AS h FROM part), f AS (SELECT *, least(1.0::DOUBLE, 512.0::DOUBLE / nullif(w, 0), 512.0::DOUBLE / nullif(h, 0)) AS scale FROM s)
       SELECT p_partkey, CASE WHEN w > 0 AND h > 0 AND w * h <= 40000000 THEN greatest(1, floor(w * scale)) END::BIGINT AS width, CASE WHEN w > 0 AND h > 0 AND w * h <= 40000000 THEN greatest(1, floor(h * scale)) END::BIGINT AS height FROM f""",
)
def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images, some of them empty or too large."""
    width, height = fitted_edges(F.col("p_partkey") * 7 + 1, F.col("p_size").cast("long") * 50 - 50, 512, 512)
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


@query(
    "cas_update",
    f"""{E_SQL}, c AS (SELECT event_id AS command_id, user_id AS file_id, event_id % 3 AS expected FROM events),
        j AS (SELECT c.*, e.file_id IS NOT NULL AS found, e.file_id % 3 AS version FROM c LEFT JOIN e USING (file_id)),
        r AS (SELECT *, min(CASE WHEN version = expected THEN command_id END) OVER (PARTITION BY file_id) AS first FROM j)
        SELECT command_id, file_id, CASE WHEN NOT found THEN 'not_found' WHEN command_id = first THEN 'applied' ELSE 'conflict' END AS verdict,
               CASE WHEN found THEN version + (first IS NOT NULL)::INT END AS version FROM r""",
)
def cas_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of the file with the user's number, each at the version its sender saw."""
    commands = table(spark, sf_dir, "events").select(F.col("event_id").alias("command_id"), F.col("user_id").alias("file_id"), F.pmod("event_id", F.lit(3)).alias("expected_version"))
    return op.compare_and_set(entries(spark, sf_dir).withColumn("version", F.pmod("file_id", F.lit(3))), commands)


@query(
    "file_deletes",
    f"""{E_SQL}, live AS (SELECT * FROM e WHERE NOT deleted), c AS (SELECT event_id AS command_id, user_id AS file_id, event_id % 3 AS expected FROM events),
        j AS (SELECT c.command_id, c.file_id, l.file_id IS NOT NULL AS found, size_bytes, object_id, CASE WHEN l.file_id % 3 = expected THEN command_id END AS ok FROM c LEFT JOIN live l ON l.file_id = c.file_id),
        r AS (SELECT *, coalesce(command_id = min(ok) OVER (PARTITION BY file_id), false) AS applied FROM j),
        held AS (SELECT object_id FROM live WHERE object_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM r WHERE applied))
        SELECT command_id, file_id, CASE WHEN NOT found THEN 'not_found' WHEN applied THEN 'applied' ELSE 'conflict' END AS verdict, CASE WHEN applied THEN size_bytes ELSE 0 END AS released_bytes,
               applied AND object_id IS NOT NULL AND object_id NOT IN (FROM held) AS gc_requested FROM r""",
)
def file_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deletes of the file with the user's number, each at the version its sender saw."""
    commands = table(spark, sf_dir, "events").select(F.col("event_id").alias("command_id"), F.col("user_id").alias("file_id"), F.pmod("event_id", F.lit(3)).alias("expected_version"))
    return op.deleted_files(entries(spark, sf_dir).withColumn("version", F.pmod("file_id", F.lit(3))), commands)


@query(
    "gc_delete_list",
    f"""{E_SQL}, g AS (SELECT object_id FROM e WHERE object_id IS NOT NULL GROUP BY object_id HAVING bool_and(deleted))
        SELECT object_id, 'object' AS kind, 'objects/sha256/' || substr(object_id, 1, 2) || '/' || object_id AS object_key FROM g
        UNION ALL SELECT object_id, 'thumbnail', 'variants/' || object_id || '.jpg' FROM g""",
)
def gc_delete_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object has a thumbnail; those of garbage go with it."""
    known = objects(spark, sf_dir)
    gone = op.garbage(known, entries(spark, sf_dir)).withColumn("object_key", object_path(F.col("object_id")))
    made = known.select("object_id", F.lit("thumbnail").alias("variant_type"), F.concat(F.lit("variants/"), "object_id", F.lit(".jpg")).alias("object_key"))
    return op.delete_list(gone, made)


@query(
    "insert_or_ignore",
    """WITH c AS (SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation), n AS (SELECT user_id AS k, arg_min(event_type, event_id) AS v FROM events GROUP BY user_id)
       SELECT k, v FROM c UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM c)""",
)
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), "event_id")
    return op.inserted_or_ignored(current, new.select("k", "v", "event_id").transform(lambda d: op.upserted(d, ["k"], [F.asc("event_id")])).select("k", "v"), ["k"], [F.asc("v")])


@query("latest_variant", "SELECT user_id, arg_max(event_type, event_id) AS latest FROM events GROUP BY user_id")
def latest_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest_by(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), F.col("event_id"))


@query("cascade_delete", f"WITH e AS ({ENTRIES_SQL}) SELECT doc_id, quality FROM labels JOIN e ON doc_id = file_id WHERE NOT deleted")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = entries(spark, sf_dir).filter("NOT deleted").select(F.col("file_id").alias("doc_id"))
    return op.cascaded(table(spark, sf_dir, "labels").select("doc_id", "quality"), kept, "doc_id")
