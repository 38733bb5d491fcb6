"""Queries over the driver tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_fault, json_depth
from ..operators import log as L
from ..operators import upkeep as U
from ..sources import views as V

SINCE, LIMIT = 100, 50
SAFE, CUTOFF_MS, ACTIVE_DAYS, GRACE_DAYS = 8000, 1706000000000, 3, 10


class Store:
    """The log and its side tables at one place."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.ops = spark, sf_dir, V.ops(spark, sf_dir)

    @property
    def owners(self) -> DataFrame:
        return L.first_writers(self.ops)

    @property
    def shares(self) -> DataFrame:
        return V.shares(self.owners)

    @property
    def viewer(self) -> DataFrame:
        return self.owners.where("playlist_id = 'p0'").select(F.col("owner_user_id").alias("user_id"))

    @property
    def cursors(self) -> DataFrame:
        return V.device_cursors(self.ops)

    @property
    def orphans(self) -> DataFrame:
        return U.orphan_report(V.blobs(self.spark, self.sf_dir), V.live_refs(self.spark, self.sf_dir), V.NOW_MS, GRACE_DAYS)


def visible(s: Store) -> DataFrame:
    return L.visible(s.ops, s.viewer, s.owners, s.shares)


def blob_totals(s: Store) -> DataFrame:
    return s.orphans.groupBy("user_id").agg(
        F.count("*").alias("total_blobs"), F.sum("size").alias("total_bytes"), F.sum(F.when(F.col("orphan"), F.col("size")).otherwise(0)).alias("orphan_bytes"), F.count_if("reclaimable").alias("reclaimable")
    )


def digests(s: Store) -> DataFrame:
    ids = F.array_join(F.transform("tracks", lambda t: F.concat(t.cast("string"), F.lit(","))), "")
    return L.members(s.ops).select("user_id", "playlist_id", F.upper(F.sha2(F.concat("playlist_id", F.lit("\n\n"), ids).cast("binary"), 256)).alias("content_hash"))


def unresolved(s: Store) -> DataFrame:
    tracks = L.members(s.ops).select("user_id", "playlist_id", F.explode("tracks").alias("track_id"))
    catalog = V.table(s.spark, s.sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("track_id"))
    return tracks.join(catalog, "track_id", "left_anti").groupBy("user_id", "playlist_id").agg(F.count("*").alias("unresolved"))


BUILD = {
    "pull_page": lambda s: L.page(visible(s), SINCE, LIMIT).select("seq", "op_id", "user_id"),
    "pull_meta": lambda s: L.page_meta(visible(s), SINCE, LIMIT),
    "head_cursor": lambda s: s.ops.groupBy("user_id").agg(F.max("seq").alias("head")),
    "op_count": lambda s: s.ops.groupBy("user_id").agg(F.count("*").alias("n")),
    "list_users": lambda s: s.ops.select("user_id").distinct(),
    "count_by_entity": lambda s: s.ops.groupBy("entity").agg(F.count("*").alias("n")),
    "playlist_ops": lambda s: s.ops.where(F.col("entity").isin("playlists", "playlist_items")).select("user_id", "seq", "entity", "entity_id", "playlist_id", "operation"),
    "validate_ops": lambda s: s.ops.withColumn("entity", F.when(F.col("seq") % 13 == 0, "tracks").otherwise(F.col("entity"))).groupBy(first_fault().alias("reason")).agg(F.count("*").alias("n")),
    "payload_depth": lambda s: s.ops.groupBy(json_depth(F.col("payload")).alias("depth")).agg(F.count("*").alias("n")),
    "append_dedup": lambda s: L.deduplicated(s.ops.unionByName(s.ops.withColumn("seq", F.col("seq") + 1000000000))).select("user_id", "op_id", "seq"),
    "first_writer": lambda s: s.owners,
    "writable_playlists": lambda s: s.owners.join(U.denied(s.owners, s.shares, s.viewer), "playlist_id", "left_anti").select("playlist_id"),
    "denied_playlists": lambda s: U.denied(s.owners, s.shares, s.viewer),
    "list_shares": lambda s: U.listed_shares(s.owners, s.shares, s.viewer),
    "device_activity": lambda s: s.cursors,
    "safe_cursor": lambda s: U.safe_cursors(s.cursors, V.NOW_MS, ACTIVE_DAYS),
    "prunable_count": lambda s: U.prunable(s.ops, SAFE, CUTOFF_MS).where("prunable").groupBy("user_id").agg(F.count("*").alias("n")),
    "prune_survivors": lambda s: U.prunable(s.ops, SAFE, CUTOFF_MS).where("not prunable").select("seq", "user_id"),
    "queue_latest": lambda s: L.latest(s.ops.where("entity = 'queue_state'").select("user_id", "entity_id", "seq", "payload", "received_at"), ["user_id", "entity_id"], F.col("seq")),
    "queue_compact_survivors": lambda s: U.superseded(s.ops, "queue_state").where("not superseded").select("seq", "user_id", "entity_id"),
    "queue_compact_removed": lambda s: U.superseded(s.ops, "queue_state").where("superseded").groupBy("user_id").agg(F.count("*").alias("removed")),
    "lww_playlists": lambda s: L.state(s.ops.where("entity = 'playlists'")).select("user_id", "entity_id", "seq"),
    "playlist_members": lambda s: L.members(s.ops).select("user_id", "playlist_id", F.array_join("tracks", ",").alias("tracks")),
    "content_hash": digests,
    "unresolved_tracks": unresolved,
    "referenced_hashes": lambda s: V.live_refs(s.spark, s.sf_dir).select("user_id", F.lower("image_hash").alias("image_hash")).distinct(),
    "blob_dedup": lambda s: V.blobs(s.spark, s.sf_dir),
    "orphan_report": lambda s: s.orphans.where("orphan").select("user_id", "image_hash", "size", "age_days", "reclaimable"),
    "orphan_totals": blob_totals,
    "reclaim_survivors": lambda s: s.orphans.where("not reclaimable").select("user_id", "image_hash"),
}
QUERIES = {name: (lambda spark, sf_dir, build=build: build(Store(spark, sf_dir))) for name, build in BUILD.items()}
