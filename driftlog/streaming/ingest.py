"""Continuous append: new files of operations, each (user, op id) once, however often it is sent, numbered in the order of arrival without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.push import first_claims, numbered, unseen
from ..sources.shared import kept
from ..sources.store import LogStore


def incoming(spark: SparkSession, folder: str, schema: StructType, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(folder)


def take(store: LogStore, batch: DataFrame, source: str, number: int) -> None:
    """Adds one micro-batch to the stored log: what the log does not hold yet, numbered on from its head by ``turn``, and the playlists it claims.

    A batch that was recorded is not added again, and one whose write failed was never seen by readers: after a restart it is numbered from the same head, so neither
    gaps nor repeats come of it.
    """
    if store.applied(source, number):
        return
    new = kept(unseen(store.read(), batch, "turn"))
    head = batch.sparkSession.createDataFrame([(store.seen().head,)], "head long")
    claims = first_claims(new.where("entity = 'playlists'").withColumn("reason", F.lit(None).cast("string"))).join(store.owners().select("playlist_id"), "playlist_id", "left_anti")
    store.append(numbered(new, "turn", head), claims, source, number)


def ingest(stream: DataFrame, store: LogStore, source: str, checkpoint: str) -> StreamingQuery:
    """Adds what has arrived and stops; late operations are accepted, as last writers are told by their stamps."""
    return stream.writeStream.foreachBatch(lambda batch, number: take(store, batch, source, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
