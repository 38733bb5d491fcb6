"""Uploaded files of images in a folder of any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upkeep import uploads_judged


def uploaded(spark: SparkSession, folder: str, claims: DataFrame, max_bytes: int) -> DataFrame:
    """The files under ``folder`` that ``claims`` (name, user_id, turn, mime_type, claimed_hash) tell of, judged: name, user_id, turn, mime, image_hash, bytes, reason.

    A file longer than ``max_bytes`` is refused by its length alone (``image_hash`` and ``bytes`` stay null): the filter is one that the source itself
    applies, so such a file is never opened. A claim without a file, or of an empty one, which the source does not list, is ``missing``.
    """
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    columns = ("name", "user_id", "turn", "mime", "image_hash", "bytes", "reason")
    small = read().where(F.col("length") <= max_bytes).select(name, F.col("content").alias("bytes"))
    judged = uploads_judged(claims.join(small, "name"), max_bytes).select(*columns)
    sizes = read().select(name, "length")
    rest = claims.join(sizes.where(F.col("length") <= max_bytes), "name", "left_anti").join(sizes, "name", "left").withColumn("bytes", F.lit(None).cast("binary"))
    by_name = uploads_judged(rest, max_bytes).withColumn("image_hash", F.lit(None).cast("string"))
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("reason") == "type", "type").otherwise("size")
    return judged.unionByName(by_name.withColumn("reason", reason).select(*columns))


def stored_image(blobs: DataFrame, user_id: int, image_hash: str) -> DataFrame:
    """mime and bytes of one image; both keys reach the scan, and no other row's bytes are read from its row group's other columns."""
    return blobs.where((F.col("user_id") == user_id) & (F.col("image_hash") == image_hash)).select("mime", "bytes")
