"""Sharing, retention, queue compaction and blob reclaim."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import age_days

IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")  # fixed values: content types an upload may have


def denied(owners: DataFrame, shares: DataFrame, viewer: DataFrame) -> DataFrame:
    """Playlists owned by others that the viewer may not edit."""
    granted = shares.where("can_edit = 1").join(viewer, F.col("grantee_user_id") == F.col("user_id"), "left_semi")
    others = owners.join(viewer, F.col("owner_user_id") == F.col("user_id"), "left_anti")
    return others.join(granted, "playlist_id", "left_anti").select("playlist_id")


def listed_shares(owners: DataFrame, shares: DataFrame, viewer: DataFrame) -> DataFrame:
    """Grants that the viewer gave or holds."""
    both = shares.join(owners.select("playlist_id", "owner_user_id"), "playlist_id").join(F.broadcast(viewer), (F.col("owner_user_id") == F.col("user_id")) | (F.col("grantee_user_id") == F.col("user_id")))
    return both.select("playlist_id", "owner_user_id", "grantee_user_id", "can_edit", "created_at", (F.col("owner_user_id") == F.col("user_id")).alias("is_owner"))


def safe_cursors(cursors: DataFrame, now_ms: int, active_days: int) -> DataFrame:
    """Per user the least cursor of the active devices, 0 without one."""
    active = age_days(F.col("updated_at"), now_ms) <= active_days
    return cursors.groupBy("user_id").agg(F.coalesce(F.min(F.when(active, F.col("cursor"))), F.lit(0)).alias("safe_cursor"))


def prunable(log: DataFrame, safe: int, cutoff_ms: int) -> DataFrame:
    """The log with a mark on play events that all devices passed and that are old, never on a user's newest operation."""
    heads = log.groupBy("user_id").agg(F.max("seq").alias("head"))
    gone = (F.col("entity") == "play_events") & (F.col("seq") <= safe) & (F.col("received_at") < cutoff_ms) & (F.col("seq") < F.col("head"))
    return log.join(heads, "user_id").withColumn("prunable", gone)


def superseded(log: DataFrame, entity: str) -> DataFrame:
    """Rows of one entity with a mark on all but the newest of each key."""
    newest = F.max("seq").over(Window.partitionBy("user_id", "entity_id"))
    return log.where(F.col("entity") == entity).withColumn("superseded", F.col("seq") < newest)


def orphan_report(blobs: DataFrame, refs: DataFrame, now_ms: int, grace_days: int) -> DataFrame:
    """Every blob with orphan, age_days and reclaimable; hashes match in either case."""
    named = refs.select("user_id", F.lower("image_hash").alias("image_hash"), F.lit(True).alias("_named")).distinct()
    aged = blobs.join(named, ["user_id", "image_hash"], "left").withColumn("orphan", F.col("_named").isNull()).drop("_named")
    return aged.withColumn("age_days", age_days(F.col("created_at"), now_ms)).withColumn("reclaimable", F.col("orphan") & (F.col("age_days") >= grace_days))


def cursors_after(cursors: DataFrame, pulls: DataFrame) -> DataFrame:
    """Device cursors after ``pulls`` (user_id, device_id, cursor, updated_at, turn): a cursor never goes back, updated_at is the last event's."""
    rows = cursors.select("user_id", "device_id", "cursor", "updated_at", F.lit(-1).cast("long").alias("turn")).unionByName(pulls.select("user_id", "device_id", "cursor", "updated_at", "turn"))
    return rows.groupBy("user_id", "device_id").agg(F.max("cursor").alias("cursor"), F.max_by("updated_at", "turn").alias("updated_at"))


def shares_after(shares: DataFrame, grants: DataFrame) -> DataFrame:
    """Shares after ``grants`` (playlist_id, grantee_user_id, can_edit, created_at, turn): the last can_edit counts, the first created_at stays."""
    key = ["playlist_id", "grantee_user_id"]
    rows = shares.select(*key, "can_edit", "created_at", F.lit(-1).cast("long").alias("turn")).unionByName(grants.select(*key, "can_edit", "created_at", "turn"))
    return rows.groupBy(*key).agg(F.max_by("can_edit", "turn").alias("can_edit"), F.min_by("created_at", "turn").alias("created_at"))


def revoked(shares: DataFrame, revokes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the shares that are left, the revokes with ``existed``)."""
    key = ["playlist_id", "grantee_user_id"]
    asked = revokes.select(*key).distinct()
    told = asked.join(shares.select(*key, F.lit(True).alias("existed")), key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))
    return shares.join(asked, key, "left_anti"), told


def retention_days(asked: int | None, configured: int) -> int:
    """A request may only be more careful than the configuration."""
    return max(asked if asked is not None else configured, configured)


def retention(log: DataFrame, cursors: DataFrame, now_ms: int, days: int) -> DataFrame:
    """The log with ``prunable`` by each user's own safe cursor: play events older than ``days`` that all devices seen within as many days have read, never a user's newest row."""
    per_user = log.groupBy("user_id").agg(F.max("seq").alias("head")).join(safe_cursors(cursors, now_ms, days), "user_id", "left")
    cutoff = now_ms - days * 86_400_000
    gone = (F.col("entity") == "play_events") & (F.col("seq") <= F.coalesce("safe_cursor", F.lit(0))) & (F.col("received_at") < cutoff) & (F.col("seq") < F.col("head"))
    return log.join(per_user, "user_id").withColumn("prunable", gone)


def retention_report(log: DataFrame, cursors: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Per user: rows by entity that count here, head, safe cursor, devices (all and active) and how many rows may go."""
    active = age_days(F.col("updated_at"), now_ms) <= days
    devices = cursors.groupBy("user_id").agg(F.count("*").alias("devices"), F.count_if(active).alias("active_devices"))
    rows = retention(log, cursors, now_ms, days).groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("entity") == "play_events").alias("play_events"), F.max("head").alias("head"), F.coalesce(F.max("safe_cursor"), F.lit(0)).alias("safe_cursor"), F.count_if("prunable").alias("prunable")
    )
    return rows.join(devices, "user_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("devices", "active_devices")})


def queue_listing(latest: DataFrame, device: str, now_ms: int) -> DataFrame:
    """Each device's newest queue state, newest first (``nth`` from 1), whose it is and how old; always told as an upsert."""
    order = Window.partitionBy("user_id").orderBy(F.desc("seq"))
    age = F.greatest(F.lit(0), F.expr(f"({now_ms} - received_at) div 1000")).cast("long")
    return latest.select("user_id", F.col("entity_id").alias("device_id"), "seq", (F.col("entity_id") == device).alias("is_current"), age.alias("age_seconds"), F.lit("upsert").alias("operation"), F.row_number().over(order).alias("nth"))


def uploads_judged(uploads: DataFrame, max_bytes: int) -> DataFrame:
    """``uploads`` (user_id, turn, mime_type, claimed_hash, bytes) with ``mime`` (bare, lower case), ``image_hash`` and the first broken rule as ``reason``."""
    mime = F.lower(F.trim(F.get(F.split("mime_type", ";"), F.lit(0))))
    real = F.sha2("bytes", 256)
    return uploads.withColumns({"mime": mime, "image_hash": real}).withColumn(
        "reason",
        F.when(~F.coalesce(F.col("mime").isin(*IMAGE_TYPES), F.lit(False)), "type")
        .when(F.octet_length("bytes") == 0, "empty")
        .when(F.octet_length("bytes") > max_bytes, "size")
        .when(~F.coalesce(F.col("claimed_hash").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)), "hash_form")
        .when(F.lower("claimed_hash") != F.col("image_hash"), "hash"),
    )


def blobs_after(blobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Blobs after sound uploads: a hash that a user already has keeps its row, of several new ones the first counts."""
    new = uploads.where("reason is null").groupBy("user_id", "image_hash").agg(F.min_by(F.struct(F.octet_length("bytes").cast("long").alias("size"), F.col("turn").alias("created_at")), "turn").alias("r"))
    key = ["user_id", "image_hash"]
    return blobs.select(*key, "size", "created_at").unionByName(new.select(*key, "r.size", "r.created_at").join(blobs, key, "left_anti"))


def orphans_listed(report: DataFrame) -> DataFrame:
    """Orphans oldest first (``nth`` from 1 per user); of one age the newer blob first, then by hash."""
    order = Window.partitionBy("user_id").orderBy(F.desc("age_days"), F.desc("created_at"), "image_hash")
    return report.where("orphan").withColumn("nth", F.row_number().over(order))


def reclaim_report(report: DataFrame) -> DataFrame:
    """Per user what a reclaim deletes, the bytes it frees, and what remains."""
    bytes_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    return report.groupBy("user_id").agg(
        F.count_if("reclaimable").alias("reclaimed"), bytes_of(F.col("reclaimable")).alias("reclaimed_bytes"), F.count_if(~F.col("reclaimable")).alias("remaining"), bytes_of(~F.col("reclaimable")).alias("remaining_bytes")
    )
