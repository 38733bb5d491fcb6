"""Joins of many rows with a table of one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # rows of a few short columns that a join may send to every task; more are dealt out with salts
SALTS = 16


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], spread: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and is cheap to count (a stored table). A small one is broadcast; of a larger
    one each row is dealt to ``SALTS`` places, and the rows of a key over them by ``spread``, so that no key is one task's work."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(dealt, [*on, "_salt"], how).drop("_salt")
