"""Cleans ``documents`` stage by stage and packs what is left into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm import decontamination, line_dedup, minhash_dedup, packing, toxicity
from driftlog.llm.common import forget, settled, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last chain probability reaches the threshold go; the chain learns from the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(toxicity.labelled_documents(docs, labels), toxicity.CATEGORIES)
    return toxicity.clean(docs, chain).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go from all but the first, each document with its near copies being a site; documents left without text go.

    A source of this corpus may hold a third of all rows, so it says too little of a line's spread to be the site here.
    """
    copies = minhash_dedup.near_duplicates(docs).select("doc_id", "component_id")
    cut = line_dedup.without_boilerplate(docs, site=None, copies=copies)
    return cut.where(r"lines_removed = 0 or text rlike '\\S'").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, of its repeated rows one.

    Rows with a null id, and rows whose text has no word, belong to no group and stay. Of an id with several texts each text
    goes or stays by its own group.
    """
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    classes = minhash_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    member = classes.where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    named = rows.where("doc_id is not null").select("row", "doc_id").join(member, "row")
    stays = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("least")).select("least.row")
    gone = named.select("row").join(stays, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces with their ids and places, read back from the training sequences."""
    import public_tokenizers

    return packing.packed(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]
#: No SQL states sketches, trained models or token packing; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        before, docs = docs, settled(stage)(spark, docs, sf_dir)
        if hasattr(before, "_driftlog_path"):
            forget(before)
    return docs
