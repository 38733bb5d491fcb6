"""One-way reconciliation of projected playlists with an external catalog, as a table of actions without side effects."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .graph import connected

PENDING = ":pending-artwork"
USER_ROWS = 50_000  # playlists and items of a user up to which they are folded as one group
WRITTEN = ("updated", "adopted", "created")
ACTIONS = ("skipped_smart", "deleted", "forgotten", "unchanged", *WRITTEN)


def resolved(playlists: DataFrame, catalog: DataFrame) -> DataFrame:
    """``playlists`` with ``resolved`` (the listed tracks that the catalog holds, in order, repeats kept) and ``unresolved`` (how many it lacks)."""
    place = playlists.select("user_id", "playlist_id", F.posexplode("tracks").alias("at", "track_id"))
    there = place.join(catalog.select("track_id").distinct().withColumn("_there", F.lit(True)), "track_id", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("_there"), F.struct("at", "track_id"))))
    lists = there.groupBy("user_id", "playlist_id").agg(F.transform(found, lambda x: x["track_id"]).alias("resolved"), F.count_if(F.col("_there").isNull()).alias("unresolved"))
    return playlists.join(lists, ["user_id", "playlist_id"], "left").withColumns(
        {"resolved": F.coalesce("resolved", F.array().cast("array<bigint>")), "unresolved": F.coalesce("unresolved", F.lit(0)).cast("long")}
    )


def hashed(playlists: DataFrame, blobs: DataFrame) -> DataFrame:
    """``playlists`` with ``content_hash`` of name, image and resolved tracks, ``artwork_missing`` where no blob has the named image (case as given), and
    ``stored_hash``, what an export of them records: while artwork is missing, a text that no content hash equals, so that the next run tries again."""
    have = blobs.select("user_id", "image_hash").distinct().withColumn("_have", F.lit(True))
    ids = F.array_join(F.transform("resolved", lambda t: F.concat(t.cast("string"), F.lit(","))), "")
    text = F.concat_ws("\n", "name", F.coalesce("image_hash", F.lit("")), ids)
    return (
        playlists.join(have, ["user_id", "image_hash"], "left")
        .withColumn("artwork_missing", (F.coalesce("image_hash", F.lit("")) != "") & F.col("_have").isNull())
        .withColumn("content_hash", F.upper(F.sha2(text.cast("binary"), 256)))
        .withColumn("stored_hash", F.concat("content_hash", F.when(F.col("artwork_missing"), PENDING).otherwise("")))
        .drop("_have")
    )


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (user_id, kind, seq, id, item, source, name, ...) with ``grp``: the user; of a user with over ``USER_ROWS`` rows the group of playlists and items that can
    come in each other's way, over mapped and source items and the names of unstamped ones."""
    by_user = F.xxhash64("user_id")
    large = kept(rows.groupBy("user_id").count().where(F.col("count") > USER_ROWS).select("user_id"))
    if large.isEmpty():
        return rows.withColumn("grp", by_user)
    key = lambda kind, c: F.xxhash64("user_id", F.lit(kind), c)
    some = rows.join(F.broadcast(large), "user_id", "left_semi")  # at most one row per USER_ROWS rows of the input
    own = F.when(F.col("kind") == 0, key("item", F.col("id"))).otherwise(key("playlist", F.col("id")))
    ends = [F.when(F.col("item").isNotNull(), key("item", F.col("item"))), F.when(F.col("source").isNotNull(), key("item", F.col("source")))]
    named = F.when((F.col("kind") == 1) | F.col("stamp").isNull(), key("name", F.col("name")))
    edges = some.select(own.alias("a"), F.explode(F.filter(F.array(own, *ends, named), lambda b: b.isNotNull())).alias("b"))
    labels = connected(edges)
    marked = rows.withColumn("_node", own).join(labels.toDF("_node", "label"), "_node", "left").drop("_node")
    return marked.withColumn("grp", F.coalesce(F.xxhash64("user_id", "label"), by_user)).drop("label")


class Catalog:
    """The items of a group as the export leaves them, playlist by playlist."""

    def __init__(self) -> None:
        self.stamp: dict[tuple, str | None] = {}
        self.name: dict[tuple, str] = {}
        self.free: dict[tuple, set] = {}

    def add(self, user, item, name, stamp) -> None:
        self.stamp[user, item], self.name[user, item] = stamp, name
        if stamp is None:
            self.free.setdefault((user, name), set()).add(item)

    def take(self, user, item, playlist) -> None:
        if self.stamp[user, item] is None:
            self.free[user, self.name[user, item]].discard(item)
        self.stamp[user, item] = playlist

    def act(self, user, playlist, item, source, name, smart, deleted, same, bad) -> tuple[str, str | None]:
        """(action, item) of one playlist, and what it does to the items."""
        there = item is not None and (user, item) in self.stamp
        if smart:
            return "skipped_smart", item
        if bad:
            return "error", item
        if deleted:
            if not there or self.stamp[user, item] is None:
                return "gone" if item is None else "forgotten", item
            del self.stamp[user, item]
            return "deleted", item
        if there:
            if same and self.stamp[user, item] == playlist:
                return "unchanged", item
            self.take(user, item, playlist)
            return "updated", item
        if source is not None and self.stamp.get((user, source), "") in (None, playlist):
            self.take(user, source, playlist)
            return "adopted", source
        named = self.free.get((user, name), ())
        if len(named) == 1:
            (only,) = named
            self.take(user, only, playlist)
            return "adopted", only
        return "created", None


def plan(playlists: DataFrame, mapping: DataFrame, items: DataFrame, well_formed: Callable[[Column], Column] | None = None) -> DataFrame:
    """user_id, playlist_id, action, target_item_id, stored_hash per playlist, as a loop over each user's playlists in the order of seq would act.

    ``playlists``: user_id, playlist_id, seq (its first), name, source_id, is_smart, deleted, content_hash, stored_hash. ``mapping``: user_id, playlist_id,
    target_item_id, content_hash of the last export. ``items``: user_id, item_id, name, stamp (the playlist it was made for, or null).
    Smart playlists are skipped, deleted ones only cleaned up (an item without any stamp is never deleted); one whose item is there, stamped for it
    and of the same content is unchanged, with an item otherwise updated. One without is given its source item if that is unstamped or its own, else the only unstamped item of its
    name in either case, else it is created. Whatever is written is stamped, so that later playlists no longer see it, and two items of one name
    become one once the other is taken.

    Where ``well_formed`` says that a mapped item's id cannot be read, that playlist alone is an ``error``: neither its item nor its mapping is touched, all others go on.

    Groups (see ``grouped``) are dealt over tasks and folded row by row in sorted order; a task holds the items of one group.
    """
    mapped = mapping.select("user_id", "playlist_id", F.col("target_item_id").alias("item"), F.col("content_hash").alias("_old"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    bad = F.col("item").isNotNull() & ~F.coalesce(well_formed(F.col("item")), no) if well_formed else no
    asked = playlists.join(mapped, ["user_id", "playlist_id"], "left").select(
        "user_id", F.lit(1).alias("kind"), "seq", F.col("playlist_id").alias("id"), "item", F.col("source_id").alias("source"), F.lower("name").alias("name"),
        none.alias("stamp"), F.coalesce("is_smart", F.lit(False)).alias("smart"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.coalesce(F.col("_old") == F.col("content_hash"), F.lit(False)).alias("same"), bad.alias("bad"), "stored_hash",
    )
    held = items.select("user_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.col("item_id").alias("id"), none.alias("item"), none.alias("source"), F.lower("name").alias("name"), "stamp", no.alias("smart"), no.alias("deleted"), no.alias("same"), no.alias("bad"), none.alias("stored_hash"))
    rows = grouped(kept(asked.unionByName(held)))

    def fold(batches):
        group, catalog = None, Catalog()
        for batch in batches:
            out = []
            for grp, user, kind, item_or_list, item, source, name, stamp, smart, deleted, same, bad, stored in zip(*(c.to_pylist() for c in batch.columns)):
                if grp != group:
                    group, catalog = grp, Catalog()
                if kind == 0:
                    catalog.add(user, item_or_list, name, stamp)
                else:
                    out.append((user, item_or_list, *catalog.act(user, item_or_list, item, source, name, smart, deleted, same, bad), stored))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (batch.schema.field("user_id").type, *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["user_id", "playlist_id", "action", "target_item_id", "stored_hash"])

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "kind", "seq", "id")
    folded = dealt.select("grp", "user_id", "kind", "id", "item", "source", "name", "stamp", "smart", "deleted", "same", "bad", "stored_hash")
    user_type = dict(rows.dtypes)["user_id"]
    return folded.mapInArrow(fold, f"user_id {user_type}, playlist_id string, action string, target_item_id string, stored_hash string")


def artwork(playlists: DataFrame, actions: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, playlist_id, artwork of the written playlists that name an image: ``missing`` without a blob, ``current`` where the item shows it already, else ``applied``."""
    shown = items.select("user_id", F.col("item_id").alias("target_item_id"), F.col("image").alias("_shown"))
    written = actions.where(F.col("action").isin(*WRITTEN)).select("user_id", "playlist_id", "target_item_id")
    named = playlists.where("image_hash <> ''").select("user_id", "playlist_id", "image_hash", "artwork_missing").join(written, ["user_id", "playlist_id"]).join(shown, ["user_id", "target_item_id"], "left")
    kind = F.when(F.col("artwork_missing"), "missing").when(F.col("_shown") == F.col("image_hash"), "current").otherwise("applied")
    return named.select("user_id", "playlist_id", kind.alias("artwork"))


def mapping_after(mapping: DataFrame, actions: DataFrame) -> DataFrame:
    """The export map after the actions: deleted and forgotten playlists leave it, written ones replace their row, others keep theirs.

    A created playlist's item id is given by the catalog, so its row stands here with a null target.
    """
    kept_rows = mapping.join(actions.where(F.col("action").isin("deleted", "forgotten", *WRITTEN)), ["user_id", "playlist_id"], "left_anti")
    columns = ["user_id", "playlist_id", "target_item_id", "content_hash"]
    return kept_rows.select(*columns).unionByName(actions.where(F.col("action").isin(*WRITTEN)).withColumnRenamed("stored_hash", "content_hash").select(*columns))


def report(actions: DataFrame, playlists: DataFrame, artworks: DataFrame) -> DataFrame:
    """Counters per user, all users in one job: each action, tracks without an item in the catalog (of playlists neither smart nor deleted), artwork applied and missing, errors."""
    key = ["user_id", "playlist_id"]
    listed = playlists.where("not is_smart and not deleted").select(*key, "unresolved")
    rows = actions.join(listed, key, "left").join(artworks, key, "left")
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    drawn = lambda a: F.count_if(F.col("artwork") == a).alias(f"artwork_{a}")
    return rows.groupBy("user_id").agg(*map(count, ACTIONS), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"), drawn("applied"), drawn("missing"), F.count_if(F.col("action") == "error").alias("errors"))
