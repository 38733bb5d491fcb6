"""The newest queue state of every device, kept up as operations stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "seq long, payload string, received_at long"


def newest_states(operations: DataFrame) -> DataFrame:
    """user_id, entity_id, seq, payload, received_at whenever a device's newest queue state changes, whatever the order of arrival; the state is one row a device.
    Operations without a sequence number, a receipt time or a device are passed over.

    The state is that of a streaming aggregation, combined before the shuffle. Beside the newest row it holds the time of the micro-batch that brought it, the
    earliest for a row sent again; a device is told of in that micro-batch only.
    """
    now = F.unix_micros(F.current_timestamp())  # one value in a micro-batch, the same when it is run again
    rows = operations.where("entity = 'queue_state' and entity_id <> '' and seq is not null and received_at is not null").withColumn("since", -now)
    newest = rows.groupBy("user_id", "entity_id").agg(F.max(F.struct("seq", "since", "payload", "received_at")).alias("newest"))
    return newest.where(F.col("newest.since") == -now).select("user_id", "entity_id", "newest.seq", "newest.payload", "newest.received_at")
