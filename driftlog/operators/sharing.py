"""Share and revoke requests in the order of arrival: who may ask, what becomes of the shares.

``events``: turn (arrival number), kind (``share`` or ``revoke``), actor, playlist_id, grantee_user_id, can_edit (null for yes), created_at. ``users``: user_id of everyone known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank

KEY = ["playlist_id", "grantee_user_id"]


def judged(events: DataFrame, owners: DataFrame, users: DataFrame) -> DataFrame:
    """``events`` with ``reason``, the first rule that a request breaks. A share: ``playlist`` (no name), ``user`` (none or unknown), ``self``, ``unknown``
    (a playlist that nobody wrote), ``not_owner``. A revoke: ``unknown``, ``not_yours`` (neither the owner's request nor the grantee's)."""
    known = users.select(F.col("user_id").alias("grantee_user_id")).distinct().withColumn("_known", F.lit(True))
    owned = owners.select("playlist_id", F.col("owner_user_id").alias("_owner"))
    marked = events.join(known, "grantee_user_id", "left").join(owned, "playlist_id", "left")
    mine = F.coalesce(F.col("_owner") == F.col("actor"), F.lit(False))
    own_grant = F.coalesce(F.col("grantee_user_id") == F.col("actor"), F.lit(False))
    share = (
        F.when(blank(F.col("playlist_id")), "playlist").when(F.col("_known").isNull(), "user").when(own_grant, "self").when(F.col("_owner").isNull(), "unknown").when(~mine, "not_owner")
    )
    revoke = F.when(F.col("_owner").isNull(), "unknown").when(~mine & ~own_grant, "not_yours")
    return marked.withColumn("reason", F.when(F.col("kind") == "share", share).otherwise(revoke)).drop("_known", "_owner")


def history(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """The sound requests behind the shares that were there, as turn -1."""
    columns = [*KEY, "turn", "kind", "can_edit", "created_at"]
    there = shares.select(*KEY, F.lit(-1).cast("long").alias("turn"), F.lit("share").alias("kind"), F.col("can_edit").cast("int").alias("can_edit"), "created_at")
    return there.unionByName(rows.where("reason is null").withColumn("can_edit", F.coalesce("can_edit", F.lit(1)).cast("int")).select(*columns))


def verdicts(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """turn and reason of ``judged`` requests; a sound revoke of a share that is not there when it comes is ``no_share``."""
    before = F.lag("kind").over(Window.partitionBy(*KEY).orderBy("turn"))
    met = history(rows, shares).select("turn", "kind", before.alias("_before")).where("turn >= 0 and kind = 'revoke' and not _before <=> 'share'").select("turn", F.lit("no_share").alias("_lacks"))
    return rows.join(met, "turn", "left").select("turn", "kind", F.coalesce("reason", "_lacks").alias("reason"))


def after(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """The shares after all requests: those granted since the last revoke; the first grant since then dates one, the last says whether it may edit."""
    all_rows = history(rows, shares)
    ended = all_rows.groupBy(*KEY).agg(F.max(F.when(F.col("kind") == "revoke", F.col("turn"))).alias("_ended"))
    live = all_rows.join(ended, KEY).where("kind = 'share' and turn > coalesce(_ended, -2)")
    return live.groupBy(*KEY).agg(F.max_by("can_edit", "turn").alias("can_edit"), F.min_by("created_at", "turn").alias("created_at"))
