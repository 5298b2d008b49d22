"""Upload sessions: plans, part reconciliation, verification, expiry and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.keys import part_count, part_size
from lodestar.functions.text import stripped, valid_name, valid_sha256
from lodestar.operators.folds import ordered_fold

ACTIVE = ("created", "uploading", "verifying")
MOST_PROGRESS = 90


def planned(sessions: DataFrame) -> DataFrame:
    """Sessions (session_id, size_bytes) with ``part_size`` and ``part_count``."""
    size = F.col("size_bytes")
    return sessions.withColumns({"part_size": part_size(size), "part_count": part_count(size)})


def latest_parts(parts: DataFrame, order: list[Column]) -> DataFrame:
    """The last write of each part of a session."""
    place = F.row_number().over(Window.partitionBy("session_id", "part_number").orderBy(*order))
    return parts.withColumn("_place", place).filter("_place = 1").drop("_place")


def completeness(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """Of each session the ``confirmed`` parts and bytes, whether they are ``complete``, and ``progress`` in percent, 90 at most."""
    sums = parts.groupBy("session_id").agg(F.count("*").alias("confirmed"), F.sum("size_bytes").alias("confirmed_bytes"))
    joined = sessions.join(sums, "session_id", "left")
    share = F.floor(100 * F.coalesce("confirmed", F.lit(0)) / F.greatest("part_count", F.lit(1)))
    return joined.select(
        "session_id",
        F.coalesce("confirmed", F.lit(0)).alias("confirmed"),
        F.coalesce("confirmed_bytes", F.lit(0)).alias("confirmed_bytes"),
        (F.coalesce("confirmed", F.lit(0)) == F.col("part_count")).alias("complete"),
        F.least(F.lit(MOST_PROGRESS), share).cast("int").alias("progress"),
    )


def nested_parts(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """Sessions with their parts as an array in part order."""
    held = parts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part_number", "size_bytes"))).alias("parts"))
    return sessions.join(held, "session_id", "left")


def verified(sessions: DataFrame, objects: DataFrame, staged: DataFrame) -> DataFrame:
    """Outcome of verifying sessions (declared sha256, size_bytes) against staged bytes (sha256, size_bytes).

    ``failed`` with a code if nothing is staged or hash or size differ; else ``reused`` if the
    content is known, and ``created`` if not.
    """
    found = staged.select("session_id", F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    known = objects.select(F.col("object_id").alias("sha256"), F.lit(True).alias("_known"))
    joined = sessions.join(found, "session_id", "left").join(known, "sha256", "left")
    same = (F.col("_sha") == F.col("sha256")) & (F.col("_size") == F.col("size_bytes"))
    outcome = F.when(F.coalesce(same, F.lit(False)), F.when(F.col("_known"), "reused").otherwise("created")).otherwise("failed")
    code = F.when(outcome == "failed", F.lit("upload.verification_failed"))
    return joined.select("session_id", outcome.alias("outcome"), code.alias("error_code"), F.when(outcome == "failed", F.col("size_bytes")).otherwise(F.lit(0)).cast("long").alias("released_bytes"))


def expired(sessions: DataFrame, now: Column, batch: int = 100) -> DataFrame:
    """The oldest active sessions past their time, a batch of them."""
    stale = sessions.filter(F.col("status").isin("created", "uploading") & (F.col("expires_at") <= now))
    return stale.orderBy("expires_at", "session_id").limit(batch)


def decisions(requests: DataFrame, sessions: DataFrame, entries: DataFrame, now: Column | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """What each create request gets: ``invalid``, ``replay``, ``name_conflict``, ``quota_exceeded``, ``instant`` (the owner has the content) or ``multipart``.

    Checked in that order. Requests have request_id, owner_id, folder_id, name, sha256,
    size_bytes and idempotency_key. A name is taken by a live entry, or by a session (owner_id, folder_id, name, status,
    expires_at, if it has these) that is active at ``now``. Content is known by hash and size. ``accounts`` (owner_id, used_bytes,
    reserved_bytes, quota_bytes) refuses requests that don't fit alone; several of a batch are a matter of ``quota_moves``.
    """
    joined = _seen(requests, sessions, entries, now)
    over = F.lit(False)
    if accounts is not None:
        joined = joined.join(accounts.select("owner_id", (F.col("quota_bytes") - F.col("used_bytes") - F.col("reserved_bytes")).alias("_free")), "owner_id", "left")
        over = F.col("size_bytes") > F.coalesce("_free", F.lit(0))
    decision = F.when(~F.col("_valid"), "invalid").when(F.col("_replay"), "replay").when(F.col("_taken"), "name_conflict").when(over, "quota_exceeded").when(F.col("_held"), "instant").otherwise("multipart")
    return joined.select("request_id", decision.alias("decision"))


def _seen(requests: DataFrame, sessions: DataFrame, entries: DataFrame, now: Column | None) -> DataFrame:
    """Requests with what the tables say about each: ``_valid``, ``_replay``, ``_taken`` (name) and ``_held`` (content)."""
    replays = sessions.select("owner_id", "idempotency_key").distinct().withColumn("_replay", F.lit(True))
    live = entries.filter(~F.col("deleted"))
    names = live.select("owner_id", "folder_id", F.lower("name").alias("_name"))
    if now is not None:
        flight = sessions.filter(F.col("status").isin(*ACTIVE) & (F.col("expires_at") > now))
        names = names.unionByName(flight.select("owner_id", "folder_id", F.lower("name").alias("_name")))
    names = names.distinct().withColumn("_taken", F.lit(True))
    content = live.select("owner_id", F.col("object_id").alias("sha256"), "size_bytes").distinct().withColumn("_held", F.lit(True))
    valid = valid_name(F.col("name")) & valid_sha256(F.col("sha256")) & (F.col("size_bytes") > 0) & F.length("idempotency_key").between(1, 128)
    return (
        requests.withColumns({"_name": F.lower(stripped(F.col("name"))), "_valid": F.coalesce(valid, F.lit(False))})
        .join(replays, ["owner_id", "idempotency_key"], "left")
        .join(names, ["owner_id", "folder_id", "_name"], "left")
        .join(content, ["owner_id", "sha256", "size_bytes"], "left")
    )


def session_id(owner: Column, key: Column) -> Column:
    """The id of the session that an owner's request with a key starts, so that a rerun starts the same."""
    return F.sha2(F.concat(F.lit("session:"), owner.cast("string"), F.lit(":"), key), 256)


def admissions(requests: DataFrame, sessions: DataFrame, entries: DataFrame, accounts: DataFrame, now: Column | None = None) -> DataFrame:
    """What each create request of a batch gets, in the order of ``request_id``: requests see what earlier ones of their owner took.

    Decisions and their order are those of ``decisions``, but a key, a name and bytes count as taken from the request on that took them; a refused
    request takes nothing, so its key may be tried again. ``session_id`` is the session that is started or replayed, ``entry_id`` the file
    of an ``instant`` one, and ``used_bytes`` and ``reserved_bytes`` are the owner's after the request. What the tables say is joined first; the
    fold of an owner holds hashes of its own names and keys of this batch, and two counters.
    """
    of = accounts.select("owner_id", F.col("used_bytes").alias("_used"), F.col("reserved_bytes").alias("_reserved"), F.col("quota_bytes").alias("_quota"))
    rows = _seen(requests, sessions, entries, now).join(of, "owner_id", "left").select(
        "request_id", "owner_id", "size_bytes", "_valid", F.coalesce("_replay", F.lit(False)).alias("_replay"), F.coalesce("_taken", F.lit(False)).alias("_taken"), F.coalesce("_held", F.lit(False)).alias("_held"),
        F.coalesce("_used", F.lit(0)).alias("_used"), F.coalesce("_reserved", F.lit(0)).alias("_reserved"), F.coalesce("_quota", F.lit(0)).alias("_quota"),
        F.xxhash64("idempotency_key").alias("_key"), F.xxhash64("folder_id", "_name").alias("_place"), session_id(F.col("owner_id"), F.col("idempotency_key")).alias("session_id"),
    )

    def step(state, row: dict):
        keys, names, used, reserved = state if state is not None else (set(), set(), row["_used"], row["_reserved"])
        size, free = row["size_bytes"], row["_quota"] - used - reserved
        if not row["_valid"]:
            decision = "invalid"
        elif row["_replay"] or row["_key"] in keys:
            decision = "replay"
        elif row["_taken"] or row["_place"] in names:
            decision = "name_conflict"
        elif size > free:
            decision = "quota_exceeded"
        else:
            decision = "instant" if row["_held"] else "multipart"
            keys.add(row["_key"])
            names.add(row["_place"])
            used, reserved = (used + size, reserved) if row["_held"] else (used, reserved + size)
        return (keys, names, used, reserved), (decision, used, reserved)

    done = ordered_fold(rows, "owner_id", ["request_id"], lambda: None, step, "decision string, used_bytes long, reserved_bytes long")
    started = F.col("decision").isin("instant", "multipart", "replay")
    entry = F.when(F.col("decision") == "instant", F.sha2(F.concat(F.lit("entry:"), "session_id"), 256))
    return done.select("request_id", "owner_id", "decision", F.when(started, F.col("session_id")).alias("session_id"), entry.alias("entry_id"), "used_bytes", "reserved_bytes")


def new_sessions(requests: DataFrame, admitted: DataFrame) -> DataFrame:
    """Sessions that a batch starts: an ``instant`` one is completed and reserves nothing, a ``multipart`` one is created with its plan and reservation."""
    rows = admitted.filter(F.col("decision").isin("instant", "multipart")).join(requests.drop("owner_id"), "request_id")
    planned_rows = planned(rows)
    parts = F.col("decision") == "multipart"
    return planned_rows.select(
        "session_id", "owner_id", "folder_id", "name", "sha256", "size_bytes", "idempotency_key", F.when(parts, "created").otherwise("completed").alias("status"),
        F.when(parts, F.col("size_bytes")).otherwise(0).cast("long").alias("reserved_bytes"), F.when(parts, F.col("part_size")).otherwise(0).cast("long").alias("part_size"), F.when(parts, F.col("part_count")).otherwise(0).cast("long").alias("part_count"), "entry_id",
    )


def new_entries(requests: DataFrame, admitted: DataFrame) -> DataFrame:
    """Files that ``instant`` requests make: a reference to content that the owner has."""
    rows = admitted.filter("decision = 'instant'").join(requests.drop("owner_id"), "request_id")
    return rows.select(F.col("entry_id").alias("file_id"), "owner_id", "folder_id", F.col("sha256").alias("object_id"), F.lower(stripped(F.col("name"))).alias("name"), "size_bytes", F.lit(False).alias("deleted"))


def usage_after(admitted: DataFrame) -> DataFrame:
    """The owners' ``used_bytes`` and ``reserved_bytes`` after a batch."""
    last = F.struct("used_bytes", "reserved_bytes")
    return admitted.groupBy("owner_id").agg(F.max_by(last, "request_id").alias("_l")).select("owner_id", "_l.used_bytes", "_l.reserved_bytes")
