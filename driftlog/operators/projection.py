"""Playlists as their payloads describe them, the routing of old logs, and pages for many devices at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import found, is_deleted, is_object, kind, read_bool, read_string, stamp
from ..sources.shared import kept
from .log import latest

KEY = ["user_id", "entity", "entity_id"]


def projected(log: DataFrame) -> DataFrame:
    """user_id, playlist_id, seq (of its first operation), name, is_smart, deleted, source_id, image_hash, tracks of every playlist of each user's own operations.

    Operations without an entity id or with a payload that is no object are passed over. The last writer counts: highest ``updated_at`` of the payload
    (``created_at`` where that is no whole number), of equal ones the highest seq. An item belongs to the playlist that its payload names; deleted ones and
    those without playlist or track go. Tracks are sorted by position (byte order, none first), equal ones by their item's first operation.
    A field counts under the first of its spellings that is present, even if its value is null.
    """
    p = F.col("payload")
    sound = log.where(F.col("entity").isin("playlists", "playlist_items") & (F.coalesce("entity_id", F.lit("")) != "") & is_object(p))
    slim = sound.select(*KEY, "seq", "operation", "payload", stamp(p, F.col("created_at")).alias("stamp"))
    first = slim.groupBy(*KEY).agg(F.min("seq").alias("first"))
    now = latest(slim, KEY, F.struct("stamp", "seq")).drop("seq").join(first, KEY).withColumn("deleted", is_deleted(F.col("operation"), p))
    text = lambda *names: read_string(found(p, *names))
    items = now.where("entity = 'playlist_items' and not deleted").select(
        "user_id", text("playlist_id", "playlistId").alias("playlist_id"), text("jellyfin_id", "jellyfinId").alias("track"), F.coalesce(text("position"), F.lit("")).alias("position"), "first"
    )
    members = items.where("playlist_id is not null and track <> ''").groupBy("user_id", "playlist_id").agg(F.array_sort(F.collect_list(F.struct("position", "first", "track"))).alias("m"))
    lists = now.where("entity = 'playlists'").select(
        "user_id", F.col("entity_id").alias("playlist_id"), F.col("first").alias("seq"), F.coalesce(text("name"), F.lit("")).alias("name"), read_bool(found(p, "is_smart", "isSmart")).alias("is_smart"),
        "deleted", text("sourceJellyfinId", "source_jellyfin_id").alias("source_id"), text("image_hash", "imageHash").alias("image_hash"),
    )
    tracks = F.coalesce(F.transform("m", lambda x: x["track"]), F.array().cast("array<string>"))
    return lists.join(members, ["user_id", "playlist_id"], "left").withColumn("tracks", tracks).drop("m")


def _extracted(payload: Column, name: str) -> Column:
    """A member as text, of any kind; true and false as 1 and 0, null as none."""
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant")
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("string")).when(~kind(value).isin("VOID"), F.try_variant_get(value, "$", "string"))


def routed_anew(log: DataFrame) -> DataFrame:
    """A log of the third version, without ``playlist_id``, as one of the fourth. This rule is older than the one for new operations: the camel-case
    spelling first, and a value of any kind."""
    item = F.coalesce(_extracted(F.col("payload"), "playlistId"), _extracted(F.col("payload"), "playlist_id"))
    return log.drop("playlist_id").withColumn("playlist_id", F.when(F.col("entity") == "playlists", F.col("entity_id")).when(F.col("entity") == "playlist_items", item))


def owners_anew(log: DataFrame) -> DataFrame:
    """The owners of a log ``routed_anew``: the first writer of each playlist's own operations, dated by their sequence number."""
    rows = log.where("entity = 'playlists' and playlist_id is not null")
    return rows.groupBy("playlist_id").agg(F.min_by("user_id", "seq").alias("owner_user_id"), F.min("seq").alias("created_at"))


def pages(log: DataFrame, cursors: DataFrame, owners: DataFrame, shares: DataFrame, limit: int, block: int = 1 << 16) -> DataFrame:
    """user_id, device_id, seq, op_id, nth of the first ``limit`` + 1 operations that each device may see after its cursor (``cursors``: user_id, device_id, cursor).

    A user sees the stream of their own operations and those of the playlists they own or were granted, without their own ones again. Of each stream a device needs
    the first ``limit`` + 1 rows after its cursor at the most, as all rows of the stream before one of these are on its page too. So every row is given its place in its stream, and every cursor
    the number of rows up to it; places are cut into leaves of ``limit`` + 1, of which a device meets two per stream. Places come from running counts in blocks of ``block`` sequence
    numbers, to which the sums of the earlier blocks are added: no task sees a whole stream, and no device meets more rows than two leaves of each.
    """
    leaf = limit + 1
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("stream")
    granted = owners.select(F.col("owner_user_id").alias("user_id"), "playlist_id").unionByName(shares.select(F.col("grantee_user_id").alias("user_id"), "playlist_id")).distinct()
    device = ("user_id", "device_id", "cursor")
    wanted = cursors.select(*device, name("u", "user_id")).unionByName(cursors.join(granted, "user_id").select(*device, name("p", "playlist_id")))
    none = F.lit(None)
    rows = log.select("seq", "op_id", name("u", "user_id"), none.cast("long").alias("author"), F.lit(0).alias("mark"))
    rows = rows.unionByName(log.where("playlist_id is not null").select("seq", "op_id", name("p", "playlist_id"), F.col("user_id").alias("author"), F.lit(0).alias("mark")))
    marks = wanted.select(F.col("cursor").alias("seq"), none.cast("string").alias("op_id"), "stream", none.cast("long").alias("author"), F.lit(1).alias("mark")).distinct()
    events = rows.unionByName(marks).withColumn("block", F.floor(F.col("seq") / block))
    sizes = events.groupBy("stream", "block").agg(F.count_if(F.col("mark") == 0).alias("n"))
    earlier = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    sizes = sizes.select("stream", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("stream", "block").orderBy("seq", "mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = kept(events.withColumn("own", F.sum(1 - F.col("mark")).over(within)).join(sizes, ["stream", "block"]).withColumn("place", F.col("before") + F.col("own")).drop("own", "before", "block"))
    starts = placed.where("mark = 1").select("stream", F.col("seq").alias("cursor"), F.col("place").alias("start"))
    leaves = F.array_distinct(F.array(F.floor(F.col("start") / leaf), F.floor((F.col("start") + limit) / leaf)))
    asked = wanted.join(starts, ["stream", "cursor"]).withColumn("leaf", F.explode(leaves))
    found = placed.where("mark = 0").withColumn("leaf", F.floor((F.col("place") - 1) / leaf)).select("stream", "leaf", "place", "seq", "op_id", "author")
    met = asked.join(found, ["stream", "leaf"]).where((F.col("place") > F.col("start")) & (F.col("place") <= F.col("start") + leaf) & (F.col("author").isNull() | (F.col("author") != F.col("user_id"))))
    order = Window.partitionBy("user_id", "device_id").orderBy("seq")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= leaf).select("user_id", "device_id", "seq", "op_id", "nth")


def cursors_of(told: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """user_id, device_id, cursor, has_more of every device after its page: the last row told, or the cursor it came with."""
    last = told.groupBy("user_id", "device_id").agg(F.max(F.when(F.col("nth") <= limit, F.col("seq"))).alias("last"), (F.max("nth") > limit).alias("has_more"))
    return cursors.join(last, ["user_id", "device_id"], "left").select("user_id", "device_id", F.coalesce("last", "cursor").alias("cursor"), F.coalesce("has_more", F.lit(False)).alias("has_more"))
