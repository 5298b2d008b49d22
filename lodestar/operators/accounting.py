"""Quotas, shares, leases and token families."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS = 180


def usage(entries: DataFrame, quota: int) -> DataFrame:
    """Of each owner ``used_bytes``, ``files`` and ``free_bytes`` of a quota, never below 0."""
    used = F.sum("size_bytes")
    return entries.filter(~F.col("deleted")).groupBy("owner_id").agg(used.alias("used_bytes"), F.count("*").alias("files"), F.greatest(F.lit(quota) - used, F.lit(0)).cast("long").alias("free_bytes"))


def gauge(entries: DataFrame, sessions: DataFrame, quota: int) -> DataFrame:
    """Of each owner with files or active sessions (``status``, ``reserved_bytes``): ``used_bytes``, ``reserved_bytes`` and ``free_bytes``, never below 0."""
    used = entries.filter(~F.col("deleted")).groupBy("owner_id").agg(F.sum("size_bytes").alias("used_bytes"))
    held = sessions.filter(F.col("status").isin("created", "uploading", "verifying")).groupBy("owner_id").agg(F.sum("reserved_bytes").alias("reserved_bytes"))
    both = used.join(held, "owner_id", "full").select("owner_id", F.coalesce("used_bytes", F.lit(0)).alias("used_bytes"), F.coalesce("reserved_bytes", F.lit(0)).alias("reserved_bytes"))
    return both.withColumn("free_bytes", F.greatest(F.lit(quota) - F.col("used_bytes") - F.col("reserved_bytes"), F.lit(0)).cast("long"))


def quota_moves(moves: DataFrame, quota: int) -> DataFrame:
    """Moves of owners' quotas (owner_id, move_id, kind, size_bytes) in order: ``accepted``, and ``used_bytes`` and ``reserved_bytes`` after each.

    ``reserve`` and ``add`` are refused, and change nothing, if used, reserved and new bytes are over the quota;
    ``release`` and ``remove`` never go below 0; ``commit`` turns reserved bytes into used ones; other kinds are refused.
    An owner's moves are sequential by their nature. They pass a task sorted by Spark, and only two counters are held.
    """
    parted = moves.select("owner_id", "move_id", "kind", "size_bytes").repartition("owner_id").sortWithinPartitions("owner_id", "move_id")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, used, reserved = object(), 0, 0
        for batch in batches:
            out = []
            for who, kind, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if who != owner:
                    owner, used, reserved = who, 0, 0
                size, ok = size or 0, kind in ("release", "remove", "commit")
                if kind in ("reserve", "add") and used + reserved + size <= quota:
                    ok, used, reserved = True, used + size * (kind == "add"), reserved + size * (kind == "reserve")
                elif kind in ("release", "commit"):
                    reserved, used = max(reserved - size, 0), used + size * (kind == "commit")
                elif kind == "remove":
                    used = max(used - size, 0)
                out.append((ok, used, reserved))
            added = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added], names=["owner_id", "move_id", "accepted", "used_bytes", "reserved_bytes"])

    kinds = {c: moves.schema[c].dataType.simpleString() for c in ("owner_id", "move_id")}
    return parted.mapInArrow(folded, f"owner_id {kinds['owner_id']}, move_id {kinds['move_id']}, accepted boolean, used_bytes long, reserved_bytes long")


def admitted(requests: DataFrame, quota: int, owner: str = "owner_id", order: str = "request_id", size: str = "size_bytes") -> DataFrame:
    """``admitted`` of each request in order: those that don't fit are refused and use nothing, so later ones may fit."""
    moves = requests.select(F.col(owner).alias("owner_id"), F.col(order).alias("move_id"), F.lit("reserve").alias("kind"), F.col(size).alias("size_bytes"))
    return quota_moves(moves, quota).select(F.col("owner_id").alias(owner), F.col("move_id").alias(order), F.col("accepted").alias("admitted"))


def share_state(shares: DataFrame, now: Column) -> DataFrame:
    """Shares with ``state``: ``revoked``, ``expired`` or ``valid``; no expiry means none."""
    state = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= now, "expired").otherwise("valid")
    return shares.withColumn("state", state)


def share_commands(commands: DataFrame, shares: DataFrame, entries: DataFrame) -> DataFrame:
    """What becomes of commands (command_id, kind, owner_id, file_id, share_id, at, expires_at): ``verdict``, and ``share_id`` of the share that is made or revoked.

    ``create`` is ``not_found`` unless the owner has the file, a ``conflict`` if it would end before it begins, else ``created``. ``revoke`` is
    ``revoked`` for the owner's own share that is in force, and the first such command of a batch only; else ``not_found``. Other kinds are ``invalid``.
    """
    live = entries.filter(~F.col("deleted")).select("owner_id", "file_id").distinct().withColumn("_file", F.lit(True))
    open_shares = shares.filter("revoked_at IS NULL").select("owner_id", "share_id").distinct().withColumn("_open", F.lit(True))
    revoking = commands.filter("kind = 'revoke'").groupBy("owner_id", "share_id").agg(F.min_by("command_id", F.struct("at", "command_id")).alias("_first"))
    seen = commands.join(live, ["owner_id", "file_id"], "left").join(open_shares, ["owner_id", "share_id"], "left").join(revoking, ["owner_id", "share_id"], "left")
    early = F.coalesce(F.col("expires_at") <= F.col("at"), F.lit(False))
    created = F.when(F.col("_file").isNull(), "not_found").when(early, "conflict").otherwise("created")
    revoked = F.when(F.col("_open") & (F.col("_first") == F.col("command_id")), "revoked").otherwise("not_found")
    verdict = F.when(F.col("kind") == "create", created).when(F.col("kind") == "revoke", revoked).otherwise("invalid")
    own = F.sha2(F.concat(F.lit("share:"), F.col("command_id").cast("string")), 256)
    done = seen.withColumn("verdict", verdict)
    share = F.when(F.col("verdict") == "created", own).when(F.col("verdict") == "revoked", F.col("share_id").cast("string"))
    return done.select("command_id", "verdict", share.alias("share_id"))


def newest_shares(shares: DataFrame, owner_id: int, limit: int = 50) -> DataFrame:
    """A page of an owner's shares, the newest first."""
    return shares.filter(F.col("owner_id") == owner_id).orderBy(F.desc("created_at"), F.desc("share_id")).limit(limit)


def resolved_shares(shares: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """What the holder of a share (share_id, file_id, revoked_at, expires_at) sees: ``state`` and, if it is ``valid``, the file.

    A share whose file is deleted is ``not_found``.
    """
    live = entries.filter(~F.col("deleted")).select("file_id", F.col("name").alias("_name"), F.col("size_bytes").alias("_size"), F.lit(True).alias("_live"))
    seen = share_state(shares, now).join(live, "file_id", "left")
    state = F.when((F.col("state") == "valid") & F.col("_live").isNull(), "not_found").otherwise(F.col("state"))
    valid = state == "valid"
    return seen.select("share_id", "file_id", state.alias("state"), F.when(valid, F.col("_name")).alias("name"), F.when(valid, F.col("_size")).alias("size_bytes"))


def provisioned(users: DataFrame, roots: DataFrame) -> DataFrame:
    """Root folders for active users (user_id, active) that have none; ids follow from the user, so a rerun adds nothing new."""
    new = users.filter("active").select(F.col("user_id").alias("owner_id")).distinct().join(roots.select("owner_id"), "owner_id", "left_anti")
    return new.select(F.sha2(F.concat(F.lit("root:"), "owner_id"), 256).alias("folder_id"), "owner_id", F.lit(None).cast("string").alias("parent_id"), F.lit("/").alias("name"))


def imports(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Share imports, one per (user, share, key): ``request_id`` of the first, ``calls``, and ``outcome``.

    ``exists`` if the user has the content already, else ``imported``: a reference, no bytes.
    """
    once = requests.groupBy("user_id", "share_id", "idempotency_key").agg(F.min("request_id").alias("request_id"), F.count("*").alias("calls"), F.min_by("object_id", "request_id").alias("object_id"))
    held = entries.filter(~F.col("deleted")).select(F.col("owner_id").alias("user_id"), "object_id").distinct().withColumn("_held", F.lit(True))
    return once.join(held, ["user_id", "object_id"], "left").select("user_id", "share_id", "request_id", "calls", F.when(F.col("_held"), "exists").otherwise("imported").alias("outcome"))


def leases(documents: DataFrame, now: Column, pipeline: str, model: str, force: bool = False) -> DataFrame:
    """``lease`` of each document: ``acquired``, ``busy`` (being processed within the lease) or ``current``."""
    busy = (F.col("status") == "processing") & (F.col("updated_at") >= now - F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS"))
    current = (F.col("status") == "indexed") & (F.col("pipeline_version") == pipeline) & (F.col("model_version") == model)
    return documents.withColumn("lease", F.when(busy, "busy").when(F.lit(not force) & current, "current").otherwise("acquired"))


def token_families(uses: DataFrame) -> DataFrame:
    """Families of refresh tokens in which a token was used twice or more: from then on all of it is revoked.

    ``uses`` has family_id, token_id, used_at; the result family_id, ``reused_at`` and ``revoked`` tokens.
    """
    second = F.row_number().over(Window.partitionBy("family_id", "token_id").orderBy("used_at", "use_id")) == 2
    marked = uses.withColumn("_second", second)
    found = marked.groupBy("family_id").agg(F.min(F.when(F.col("_second"), F.col("used_at"))).alias("reused_at"), F.count_distinct("token_id").alias("revoked"))
    return found.filter("reused_at IS NOT NULL")
