"""Accepting pushed batches: gates, envelope rules, ownership and permissions in the order of arrival, the append and what it makes superfluous.

Batches have one row per operation: batch_id, turn (arrival number, rising from batch to batch), user_id and device_id (one of each per batch), op_id,
entity, operation, entity_id, payload, created_at, received_at and playlist_id, the playlist an operation is routed to (null for personal ones).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank, first_fault
from ..sources.shared import kept
from .joins import looked_up
from .log import deduplicated

NUMBERED_TOGETHER = 1_000_000  # arrival numbers that are ranked in one group, at the least
RANGES = 1_000  # groups in which arrival numbers are ranked, at the most


def gated(batches: DataFrame, max_ops: int) -> DataFrame:
    """batch_id, n and the verdict on each whole batch: ``too_many``, then ``no_device`` (blank in the batch and, where there is such a column, in
    ``session_device``), else ``ok``."""
    device = F.max(F.when(~blank(F.col("device_id")), F.col("device_id")))
    if "session_device" in batches.columns:
        device = F.coalesce(device, F.max(F.when(~blank(F.col("session_device")), F.col("session_device"))))
    verdict = F.when(F.col("n") > max_ops, "too_many").when(F.col("_device").isNull(), "no_device").otherwise("ok")
    return batches.groupBy("batch_id").agg(F.count("*").alias("n"), device.alias("_device")).select("batch_id", "n", verdict.alias("verdict"))


def checked(batches: DataFrame, max_ops: int) -> DataFrame:
    """The operations of admitted batches, without their payloads, and ``reason``, the first envelope rule broken."""
    admitted = gated(batches, max_ops).where("verdict = 'ok'").select("batch_id")
    return batches.join(admitted, "batch_id", "left_semi").withColumn("reason", first_fault()).drop("payload")


def first_claims(rows: DataFrame) -> DataFrame:
    """playlist_id, owner_user_id, created_at: who first pushed a sound operation to each playlist, and when."""
    named = rows.where("reason is null and playlist_id <> ''")
    return named.groupBy("playlist_id").agg(F.min_by("user_id", "turn").alias("owner_user_id"), F.min_by("received_at", "turn").alias("created_at"))


def owners_after(owners: DataFrame, rows: DataFrame) -> DataFrame:
    """The owners once all batches are in: a playlist keeps the owner it has, one without goes to the first who pushed to it.

    As nobody is denied an unowned playlist, the first sound operation on it is always accepted and claims it; whoever comes later is judged by that
    claim. So the fold over the batches' order is the least arrival number per playlist, combined before the shuffle.
    """
    known = owners.select("playlist_id", "owner_user_id", "created_at")
    return known.unionByName(first_claims(rows).join(known.select("playlist_id"), "playlist_id", "left_anti"))


def judged_by(rows: DataFrame, owners: DataFrame, shares: DataFrame) -> DataFrame:
    """``checked`` rows with ``denied`` as the reason where a sound operation goes to a playlist that another owns, by an earlier claim too, and that the
    pusher may not edit. One without a playlist's name is denied only beside others that have one."""
    known = owners.select("playlist_id", F.col("owner_user_id").alias("_owner"))
    editable = shares.where("can_edit = 1").select("playlist_id", F.col("grantee_user_id").alias("user_id"), F.lit(True).alias("_editable")).distinct()
    scoped = rows.groupBy("batch_id").agg(F.max(F.col("reason").isNull() & (F.coalesce("playlist_id", F.lit("")) != "")).alias("scoped"))
    marked = looked_up(looked_up(rows, known, ["playlist_id"], "turn"), kept(editable), ["playlist_id", "user_id"], "turn").join(scoped, "batch_id")
    others = (F.col("_owner") != F.col("user_id")) & F.col("_editable").isNull()
    denied = F.when(F.col("playlist_id") == "", F.col("scoped")).otherwise(others)
    return marked.withColumn("reason", F.coalesce("reason", F.when(denied, "denied"))).drop("_owner", "_editable", "scoped")


def judged(batches: DataFrame, owners: DataFrame, shares: DataFrame, max_ops: int) -> DataFrame:
    """The operations of admitted batches with ``reason``: the first broken rule, ``denied``, or null for an accepted one."""
    return Push(batches, owners, shares, max_ops=max_ops).judged


def numbered(rows: DataFrame, arrival: str, base: DataFrame) -> DataFrame:
    """``rows`` with seq, gapless in arrival order from the one-row ``base`` (head) on.

    Arrival numbers are ranked within ranges of equal width, ``RANGES`` at most, and the ranges' sizes summed up: no task sees all rows unless most
    numbers crowd into one range of widely scattered ones.
    """
    (least, most), (head,) = rows.agg(F.min(arrival), F.max(arrival)).first(), base.select("head").first()
    width = max(NUMBERED_TOGETHER, (int(most or 0) - int(least or 0)) // RANGES + 1)
    ranged = rows.withColumn("_range", F.floor((F.col(arrival) - F.lit(least or 0)) / width))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(arrival))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn("seq", (F.lit(head) + F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def unseen(log: DataFrame, batch: DataFrame, arrival: str) -> DataFrame:
    """The batch's rows that the log does not hold yet, each (user, op id) once, the first to arrive."""
    return deduplicated(batch, arrival).join(log.select("user_id", "op_id"), ["user_id", "op_id"], "left_anti")


def appended(log: DataFrame, batch: DataFrame, arrival: str) -> DataFrame:
    """``unseen`` rows numbered on from the log's head in arrival order."""
    return numbered(kept(unseen(log, batch, arrival)), arrival, log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head")))


def heads(log: DataFrame, new: DataFrame) -> DataFrame:
    """Each pusher's newest own sequence number after the push."""
    pushed = new.select("user_id").distinct()
    return log.select("user_id", "seq").unionByName(new.select("user_id", "seq")).join(pushed, "user_id", "left_semi").groupBy("user_id").agg(F.max("seq").alias("head"))


def superseded_by(log: DataFrame, accepted: DataFrame, new: DataFrame) -> DataFrame:
    """user_id, entity_id, seq of the queue states that a push makes superfluous: all but the newest of each device that an accepted operation names."""
    key = ["user_id", "entity_id"]
    touched = accepted.where("entity = 'queue_state' and entity_id <> ''").select(*key).distinct()
    rows = log.where("entity = 'queue_state'").select(*key, "seq").unionByName(new.where("entity = 'queue_state'").select(*key, "seq")).join(touched, key, "left_semi")
    newest = rows.groupBy(*key).agg(F.max("seq").alias("newest"))
    return rows.join(newest, key).where("seq < newest").drop("newest")


@dataclass
class Push:
    """All that follows from pushing ``batches`` on a log and its side tables; each step is computed once, when it is asked for. Payloads are read to judge
    them and to append them, and take no part in what lies between."""

    batches: DataFrame
    owners: DataFrame
    shares: DataFrame
    log: DataFrame | None = None
    max_ops: int = 1000

    @cached_property
    def rows(self) -> DataFrame:
        return kept(checked(self.batches, self.max_ops))

    @cached_property
    def owners_now(self) -> DataFrame:
        return kept(owners_after(self.owners, self.rows))

    @cached_property
    def judged(self) -> DataFrame:
        return kept(judged_by(self.rows, self.owners_now, self.shares))

    @property
    def accepted(self) -> DataFrame:
        return self.judged.where("reason is null")

    @cached_property
    def appended(self) -> DataFrame:
        return kept(appended(self.log, self.accepted, "turn"))

    @property
    def new_rows(self) -> DataFrame:
        """The appended rows with their payloads."""
        return self.appended.join(self.batches.select("turn", "payload"), "turn")

    @property
    def heads(self) -> DataFrame:
        return heads(self.log, self.appended)

    @property
    def superfluous(self) -> DataFrame:
        return superseded_by(self.log, self.accepted, self.appended)
