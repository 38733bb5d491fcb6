"""Queries over the log as a stored table, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import log as L
from ..operators import push as P
from ..operators import upkeep as U
from ..sources import views as V
from ..sources.shared import kept, shared_folder
from ..sources.store import LogStore
from ..streaming import ingest as I
from ..streaming import queues as N
from .queries import CUTOFF_MS, LIMIT, SAFE, SINCE
from .service import MAX_OPS, Service

COMMITS = 3
_read_only: dict[tuple[str, str], LogStore] = {}


def filled(s: Service) -> LogStore:
    """A new store that the log came into in several commits, by sequence number."""
    store = LogStore(s.spark, f"{shared_folder(s.spark)}/driftlog-log-{uuid.uuid4().hex}")
    rows = kept(s.ops)
    head = rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    owners = kept(L.first_writers(rows).join(rows.where("entity = 'playlists'").groupBy("playlist_id").agg(F.min("seq").alias("seq")), "playlist_id"))
    for k in range(COMMITS):
        within = (F.col("seq") > head * k // COMMITS) & (F.col("seq") <= head * (k + 1) // COMMITS)
        store.append(rows.where(within), owners.where(within))
    return store


def shared_store(s: Service) -> LogStore:
    """A filled store that queries only read: one per session and source."""
    key = (s.spark.sparkContext.applicationId, s.sf_dir)
    if key not in _read_only:
        _read_only[key] = filled(s)
    return _read_only[key]


def viewer(owners: DataFrame) -> DataFrame:
    return owners.where("playlist_id = 'p0'").select(F.col("owner_user_id").alias("user_id"))


def pull_page(s: Service) -> DataFrame:
    store = shared_store(s)
    owners = kept(store.owners())
    return L.page(L.visible(store.read(since=SINCE), viewer(owners), owners, V.shares(owners)), SINCE, LIMIT).select("seq", "op_id", "user_id")


def playlist_ops(s: Service) -> DataFrame:
    """The viewer's own playlist operations, in order."""
    store = shared_store(s)
    rows = store.read(entities=["playlists", "playlist_items"])
    return rows.join(F.broadcast(viewer(store.owners())), "user_id", "left_semi").select("seq", "entity", "entity_id", "playlist_id", "operation", F.row_number().over(Window.partitionBy("user_id").orderBy("seq")).alias("nth"))


def pruned(s: Service) -> LogStore:
    store = filled(s)
    gone = U.prunable(store.read(), SAFE, CUTOFF_MS).where("entity = 'play_events' and not prunable")
    store.rewrite("play_events", gone)
    return store


def compacted(store: LogStore) -> LogStore:
    store.rewrite("queue_state", U.superseded(store.read(entities=["queue_state"]), "queue_state").where("not superseded"))
    return store


def summary(s: Service) -> DataFrame:
    """Each user's counts and head after a prune and a compaction, without a scan of the log."""
    return compacted(pruned(s)).summaries()


def pushed(s: Service) -> DataFrame:
    """What a push adds to a stored log, read back from it, and its owners' claims with it."""
    store = LogStore(s.spark, f"{shared_folder(s.spark)}/driftlog-log-{uuid.uuid4().hex}")
    store.append(s.push_on_log.log, s.some_owners)
    push = P.Push(s.push.batches, store.owners(), s.shares, store.read(), MAX_OPS)
    before = store.seen().head
    store.append(push.new_rows, push.owners_now.join(store.owners().select("playlist_id"), "playlist_id", "left_anti"))
    return store.read(since=before).join(store.owners().select("playlist_id", "owner_user_id"), "playlist_id", "left").select("user_id", "op_id", "seq", "entity", "playlist_id", "owner_user_id")


def ingested(s: Service) -> DataFrame:
    """The log as it streams in: deliveries one after the other, taken in as each has arrived, with operations sent again in later ones."""
    folder = f"{shared_folder(s.spark)}/driftlog-stream-{uuid.uuid4().hex}"
    rows, store = kept(s.ops), LogStore(s.spark, f"{folder}/log")
    for k in range(COMMITS):
        turn = 10 * F.col("seq") + k * 10_000_000_000
        first = rows.where(f"seq % 18 >= {6 * k} and seq % 18 < {6 * k + 6}").withColumn("turn", turn)
        again = rows.where(f"seq % {COMMITS} = {k} and seq % 7 = 0 and seq % 2 = {k % 2}").withColumn("turn", turn + 1)
        sent = first.unionByName(again).drop("seq")
        sent.write.parquet(f"{folder}/in/{k}")
        I.ingest(I.incoming(s.spark, f"{folder}/in/*", sent.schema), store, "events", f"{folder}/marks").awaitTermination()
    return store.read().select("seq", "user_id", "op_id", "entity")


def queue_stream(s: Service) -> DataFrame:
    """Each device's newest queue state as a stream keeps it, its deliveries sent in the reverse order; the last word on every device is told."""
    folder = f"{shared_folder(s.spark)}/driftlog-stream-{uuid.uuid4().hex}"
    rows = kept(s.ops)
    head = rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    changes = N.newest_states(I.incoming(s.spark, f"{folder}/in/*", rows.schema))
    told = changes.writeStream.outputMode("update").foreachBatch(lambda part, number: part.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"))
    told = told.option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True)
    for k in range(COMMITS):
        rows.where((F.col("seq") > head * (COMMITS - 1 - k) // COMMITS) & (F.col("seq") <= head * (COMMITS - k) // COMMITS)).write.parquet(f"{folder}/in/{k}")
        told.start().awaitTermination()
    said = s.spark.read.schema(f"user_id long, entity_id string, {N.ROW}, batch int").parquet(f"{folder}/out")
    return L.latest(said, ["user_id", "entity_id"], F.col("batch")).drop("batch")


BUILD = {
    "store_pull_page": pull_page,
    "store_playlist_ops": playlist_ops,
    "store_pruned": lambda s: pruned(s).read().select("seq", "user_id", "entity"),
    "store_compacted": lambda s: compacted(filled(s)).read().select("seq", "user_id", "entity"),
    "store_summary": summary,
    "store_push": pushed,
    "store_ingest": ingested,
    "queue_stream": queue_stream,
}
QUERIES = {name: (lambda spark, sf_dir, build=build: build(Service(spark, sf_dir))) for name, build in BUILD.items()}
