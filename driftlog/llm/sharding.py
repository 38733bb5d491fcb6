"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters rows: the shard comes from the key alone (rendezvous hashing, so one more shard takes rows only
into itself) and a seeded hash spreads each shard's rows uniformly over buckets small enough for one task's memory.
Pass two shuffles each bucket (``shuffle`` is a Fisher-Yates pass over the bucket's array) and numbers its rows
behind those of the shard's earlier buckets.

Defined cases: a null key is a key like any other; repeated rows each keep their own slot, and a key that holds many
rows still spreads over all buckets of its shard, because the scatter also hashes the row's number in its input
partition. Other columns travel along, those with the names of the operator's own (``shard``, ``slot``, ``grown_shard``) with
an underscore added; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, stored

SEED = 20240131
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 200_000
OWN = ("shard", "slot", "grown_shard")


def shard_of(key, shards: int, seed: int = SEED):
    """The shard with the highest seeded hash of (key, shard)."""
    draws = F.array(*(F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)))
    return F.array_max(draws)["s"]


def shuffled_shards(docs: DataFrame, key: str, size: str, shards: int, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard).

    ``size`` names the column with a row's bytes; it sets how many buckets a shard is scattered into.
    """
    total, rows = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    buckets = 1 + max(total // (shards * BUCKET_BYTES), rows // (shards * BUCKET_ROWS))
    names = list(docs.columns)
    for i, c in enumerate(names):
        while names[i] in OWN or names.count(names[i]) > 1:
            names[i] += "_"
    scattered = stored(
        docs.select(
            F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names))).alias("_row"),
            shard_of(F.col(key), shards, seed).alias("_shard"),
            shard_of(F.col(key), shards + 1, seed).alias("_grown"),
            F.xxhash64(F.lit(seed), F.lit("row"), F.col(key), F.monotonically_increasing_id()).alias("_draw"),
        ).withColumn("_bucket", F.pmod("_draw", F.lit(buckets)))
    )
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = scattered.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    mixed = scattered.groupBy("_shard", "_bucket").agg(F.shuffle(F.sort_array(F.collect_list(F.struct("_draw", "_grown", "_row"))), seed).alias("_rows"))
    return (
        dealt(mixed, starts.drop("_n"), ["_shard", "_bucket"], shards * buckets, F.lit(0))
        .select("_shard", "_from", F.posexplode("_rows").alias("_at", "_item"))
        .select("_item._row.*", F.col("_shard").alias("shard"), (F.col("_from") + F.col("_at")).alias("slot"), F.col("_item._grown").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, key: str, size: str, shards: int) -> None:
    """Writes the shards as Parquet, one folder per shard, each bucket's rows in slot order."""
    shuffled_shards(docs, key, size, shards).write.option("compression", "zstd").partitionBy("shard").parquet(path)
