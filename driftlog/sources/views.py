"""The driver tables in the shape of an operation log and its side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1706745600000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: one operation per event."""
    k = F.get_json_object("props", "$.k").cast("long")
    device = F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string"))
    playlist = F.concat(F.lit("p"), (k % 20).cast("string"))
    of = lambda kind: F.col("event_type") == kind
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("event_id").cast("string").alias("op_id"),
        "user_id",
        device.alias("device_id"),
        F.when(of("purchase"), "playlists").when(of("click"), "playlist_items").when(of("view"), "play_events").when(of("signup"), "queue_state").otherwise("likes").alias("entity"),
        F.when(of("purchase"), playlist)
        .when(of("click"), F.concat(F.lit("i"), k.cast("string")))
        .when(of("signup"), device)
        .otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string")))
        .alias("entity_id"),
        F.when(of("purchase") | of("click"), playlist).alias("playlist_id"),
        F.when(F.col("event_id") % 11 == 0, "delete").otherwise("upsert").alias("operation"),
        F.col("props").alias("payload"),
        ms.alias("created_at"),
        (ms + F.col("event_id") % 60000).alias("received_at"),
        F.floor(F.col("value") * 100).cast("long").alias("stamp"),
        k.alias("track_id"),
    )


def shares(owners: DataFrame) -> DataFrame:
    """Playlist n is shared with the owners of n+1 and n+2 (mod 20), odd n editable."""
    n = lambda c: F.substring(c, 2, 9).cast("int")
    to = owners.select(n("playlist_id").alias("m"), F.col("owner_user_id").alias("grantee_user_id"))
    grants = owners.withColumn("n", n("playlist_id")).withColumn("m", F.explode(F.array((F.col("n") + 1) % 20, (F.col("n") + 2) % 20)))
    return (
        grants.join(to, "m")
        .where("grantee_user_id <> owner_user_id")
        .groupBy("playlist_id", "grantee_user_id")
        .agg(F.max(F.col("n") % 2).alias("can_edit"), F.min("created_at").alias("created_at"))
    )


def device_cursors(log: DataFrame) -> DataFrame:
    return log.where("seq % 5 <> 0").groupBy("user_id", "device_id").agg(F.max("seq").alias("cursor"), F.max("received_at").alias("updated_at"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("user_id"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("image_hash"), F.octet_length("text").alias("bytes"))
    made = F.lit(1704067200000) + (F.col("doc_id") % 60) * 86400000
    return docs.groupBy("user_id", "image_hash").agg(F.max("bytes").cast("long").alias("size"), F.min(made).alias("created_at"))


def live_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(named, "doc_id", "left_semi")
    return docs.select((F.col("doc_id") % 7).alias("user_id"), F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("image_hash")).distinct()
