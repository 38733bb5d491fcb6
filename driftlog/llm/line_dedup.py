"""Removal of lines that spread over sites.

Every line's sites go into a HyperLogLog sketch per line, merged by aggregation; lines whose estimate lies near the
threshold get an exact distinct count. A line on ``MIN_SITES`` distinct sites or more, whatever its length, is boilerplate: all its
occurrences go but the first (smallest doc_id, then position), so no text leaves the corpus altogether. Lines are told apart by
two 64-bit hashes of different seeds.

``site`` names the column with a document's site; without one, each document is a site of its own. Where a later stage removes near
copies, ``copies`` names each document's group of them. A document then counts for the site of its group's original only, so
that copies alone never make a text boilerplate, and a line that stays in its first document stays in that document's copies
too (once in each), so that copies remain copies.

Defined cases: lines are compared trimmed and lower-cased; lines without a letter or digit are kept; a null site is a site
of the document's own; a null text stays null and an empty one empty; repeated rows of an id are one document, all
cleaned alike; columns keep their order, others travel along (one named ``lines_removed`` gives way to the operator's);
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, settled, stored

MIN_SITES, NEAR = 2, 1
LINE = ["one", "two"]


def spread(lines: DataFrame) -> DataFrame:
    """one, two, first (doc, at, family) of the lines that reach the threshold; ``lines`` has one, two, doc, at, family, site."""
    sketched = stored(
        lines.groupBy(*LINE)
        .agg(F.hll_sketch_agg("site", F.lit(12)).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc", "at", "family")).alias("first"))
        .where("n > 1")
        .select(*LINE, "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= MIN_SITES - NEAR)
    )
    near = sketched.where(F.col("sites") <= MIN_SITES + NEAR)
    counted = dealt(lines.select(*LINE, "site"), near.select(*LINE), LINE, near.count(), F.col("site"))
    exact = counted.distinct().groupBy(*LINE).agg(F.count("*").alias("exact")).where(F.col("exact") >= MIN_SITES)
    sure = sketched.where(F.col("sites") > MIN_SITES + NEAR).select(*LINE, "first")
    return sure.unionByName(near.join(exact, LINE, "left_semi").select(*LINE, "first"))


def families(docs: DataFrame, site: str | None, copies: DataFrame) -> DataFrame:
    """doc, original, theirs (the original's site) of the documents that are copies of another."""
    moved = copies.where("component_id <> doc_id").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("component_id").alias("original"))
    if site is None:
        return moved.withColumn("theirs", F.lit(None).cast("string"))
    owns = docs.groupBy(F.col("doc_id").cast("long").alias("original")).agg(F.min(F.col(site).cast("string")).alias("theirs"))
    return moved.join(owns, "original", "left")


def without(lines: str, positions: str):
    """The text without the lines at sorted ``positions``: the runs between them, each copied once."""
    cuts = F.concat(F.array(F.lit(-1)), F.col(positions), F.array(F.size(lines)))
    runs = F.transform(
        F.array(F.struct(F.col(lines).alias("lines"), cuts.alias("cuts"))),
        lambda s: F.array_join(
            F.flatten(F.transform(F.sequence(F.lit(1), F.size(s["cuts"]) - 1), lambda j: F.slice(s["lines"], F.get(s["cuts"], j - 1) + 2, F.get(s["cuts"], j) - F.get(s["cuts"], j - 1) - 1))), "\n"
        ),
    )
    return F.get(runs, F.lit(0))


@settled
def without_boilerplate(docs: DataFrame, site: str | None = "source", copies: DataFrame | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text`` and n_chars, where there is one, set anew; lines_removed says how many.

    ``copies`` has doc_id and component_id, the smallest doc_id of the document's group of near copies.
    """
    own = F.lit(None).cast("string") if site is None else F.col(site).cast("string")
    read = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("print"), own.alias("own"), "text")
    if copies is None:
        read = read.withColumns({"family": F.col("doc"), "theirs": F.col("own")})
    else:
        moved = stored(families(docs, site, copies))
        read = dealt(read, moved, ["doc"], moved.count(), F.col("print"), "left").withColumns(
            {"family": F.coalesce("original", "doc"), "theirs": F.when(F.col("original").isNull(), F.col("own")).otherwise(F.col("theirs"))}
        )
    place = F.when(F.col("theirs").isNull(), F.concat(F.lit("d"), F.coalesce(F.col("family").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("s"), "theirs"))
    cut = read.select("doc", "print", "family", place.alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.lower(F.trim("line"))
    lines = stored(
        cut.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select(F.xxhash64(line).alias("one"), F.xxhash64(F.lit(1), line).alias("two"), "doc", "print", "family", "at", "site")
    )
    wide = stored(spread(lines))
    found = dealt(lines, wide, LINE, wide.count(), F.col("doc"))
    if copies is None:
        found = found.where("not (doc <=> first.doc and at = first.at)")
    else:
        found = found.withColumn("again", F.row_number().over(Window.partitionBy(*LINE, "doc", "print").orderBy("at")) > 1).where("again or not family <=> first.family")
    drops = found.groupBy(F.col("doc").alias("_doc"), F.col("print").alias("_print")).agg(F.sort_array(F.collect_set("at")).alias("_drop"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    marked = rows.join(drops, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_print")), "left").withColumn("_lines", F.when(F.col("_drop").isNotNull(), F.split("_row.text", "\n")))
    text = F.when(F.col("_drop").isNull(), F.col("_row.text")).otherwise(without("_lines", "_drop"))
    cleaned = marked.select("_row", "_drop", text.alias("_text"))
    fixed = {"text": F.col("_text"), "n_chars": F.when(F.col("_drop").isNull(), F.col("_row.n_chars")).otherwise(F.char_length("_text").cast("long")) if "n_chars" in docs.columns else None}
    kept = [c for c in docs.columns if c != "lines_removed"]
    return cleaned.select(*(fixed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in kept), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("lines_removed"))
