"""Appending to, reading and folding the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_writers(log: DataFrame) -> DataFrame:
    """Each playlist's owner: the user of its first operation."""
    rows = log.where("entity = 'playlists'")
    return rows.groupBy("playlist_id").agg(F.min_by("user_id", "seq").alias("owner_user_id"), F.min("received_at").alias("created_at"))


def visible(log: DataFrame, viewer: DataFrame, owners: DataFrame, shares: DataFrame) -> DataFrame:
    """Operations of the viewer (one row, user_id) and of playlists they own or were granted, each once."""
    seen = (
        owners.join(viewer, F.col("owner_user_id") == F.col("user_id"), "left_semi")
        .select("playlist_id")
        .unionByName(shares.join(viewer, F.col("grantee_user_id") == F.col("user_id"), "left_semi").select("playlist_id"))
        .distinct()
    )
    me, listed = viewer.select(F.col("user_id").alias("_me")), seen.select(F.col("playlist_id").alias("_seen"))
    marked = log.join(me, F.col("user_id") == F.col("_me"), "left").join(listed, F.col("playlist_id") == F.col("_seen"), "left")
    return marked.where("_me is not null or _seen is not null").drop("_me", "_seen")


def page(rows: DataFrame, since: int, limit: int) -> DataFrame:
    """The first ``limit`` + 1 rows after the cursor; the extra one tells that there are more."""
    return rows.where(F.col("seq") > since).orderBy("seq").limit(limit + 1)


def page_meta(rows: DataFrame, since: int, limit: int) -> DataFrame:
    """has_more and the next cursor of a page."""
    numbered = page(rows, since, limit).agg(F.sort_array(F.collect_list("seq")).alias("seqs"))  # limit + 1 rows at most
    return numbered.select(
        (F.size("seqs") > limit).alias("has_more"),
        F.coalesce(F.try_element_at("seqs", F.least(F.lit(limit), F.greatest(F.size("seqs"), F.lit(1)))), F.lit(since)).cast("long").alias("cursor"),
    )


def deduplicated(batch: DataFrame, arrival: str = "seq") -> DataFrame:
    """One row per (user, op id): the one that arrived first."""
    order = Window.partitionBy("user_id", "op_id").orderBy(arrival)
    return batch.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Each key's row with the highest ``order``, by an aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def state(log: DataFrame) -> DataFrame:
    """Current rows by last writer: highest stamp, of equal stamps the highest seq; deleted ones marked."""
    folded = latest(log, ["user_id", "entity", "entity_id"], F.struct("stamp", "seq"))
    return folded.withColumn("deleted", F.col("operation") == "delete")


def members(log: DataFrame) -> DataFrame:
    """Each user's playlists with their live tracks in order (an empty list where there are none)."""
    return members_of(state(log.where("entity in ('playlists', 'playlist_items')")))


def members_of(folded: DataFrame) -> DataFrame:
    """``members`` of a log that was folded by ``state``."""
    now = folded.where("not deleted")
    items = (
        now.where("entity = 'playlist_items'")
        .groupBy("user_id", "playlist_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("entity_id").alias("position"), "seq", "track_id"))).alias("m"))
        .select("user_id", "playlist_id", F.transform("m", lambda x: x["track_id"]).alias("tracks"))
    )
    lists = now.where("entity = 'playlists'").select("user_id", F.col("entity_id").alias("playlist_id"))
    return lists.join(items, ["user_id", "playlist_id"], "left").withColumn("tracks", F.coalesce("tracks", F.array().cast("array<bigint>")))
