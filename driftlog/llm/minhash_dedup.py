"""Near-duplicate documents by SetSketch registers: band, estimate jointly by likelihood, verify on full sets.

``near_duplicates`` gives every row of ``docs`` its number of distinct 5-word shingles, the smallest doc_id
reachable over links (itself included) and whether it is that one. Two texts are linked when
100 * |intersection| >= percent * |union|.

Defined cases: null, empty or wordless texts have an empty set and no links; fewer than five words are one
shingle; equal sets are one node, however many copies there are; rows with a null id keep their own row with a
null component and stay kept. Repeated rows are harmless; an id with several texts is a row for each of them, placed by its own
text's links. Other columns are left alone, an empty table gives an empty result.

Scale: copies collapse by an aggregation before anything is paired. A band's bucket never emits all its pairs: its members are
dealt over ``SALTS`` sub-buckets and tied to the next larger one there, and the sub-buckets' least members are tied to each
other. After the components of these links only buckets that still hold several components are compared further, in square blocks
of bounded size whose members meet in a task's memory; only links leave a block.
Texts travel only for members of a bucket of two or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, arrow_texts, connected_components, release, settled, stored
from .shingles import SetSketch, mix, shingle_sets

WORDS, PERCENT = 5, 75
REGISTERS, ROWS = 384, 6  # 64 bands of 6: a pair at 0.75 meets in none with a chance of 4e-6
SLACK = 0.14  # six standard deviations of the estimate at 0.75
TIES = 16  # earlier members that a node is tied to, at most; what they leave apart is compared in blocks
BLOCK, BLOCK_SHINGLES = 512, 1 << 19  # members and shingles on a side of the square blocks in which open buckets are compared
GROUP = 1 << 16  # members of connected open buckets that are compared as one group


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a hash of the text, n_shingles, two 64-bit fingerprints of the whole set, and its registers."""
    sketch = SetSketch(REGISTERS)

    def run(batches):
        for batch in batches:
            n, one, two, regs = [], [], [], []
            for s in shingle_sets(arrow_texts(batch.column(2)), WORDS):
                n.append(len(s))
                one.append(int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0)
                two.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                regs.append(sketch.registers(s).tobytes() if len(s) else None)
            release()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)), pa.array(regs, pa.binary())],
                names=["id", "print", "n_shingles", "one", "two", "registers"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, "id long, print long, n_shingles long, one long, two long, registers binary")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).cast("binary").alias("text"))


def band_rows(nodes: DataFrame) -> DataFrame:
    """(band, node, n): one row per node and band; the band key holds its number and its six registers."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                regs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1, ROWS).astype(np.int64)
                bands = regs.shape[1]
                key = (regs << (8 * np.arange(ROWS))).sum(2) | (np.arange(bands) << (8 * ROWS))
                each = lambda c: pa.array(np.repeat(c.to_numpy(), bands))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), each(part.column(0)), each(part.column(1))], names=["band", "node", "n"])

    return nodes.select("node", "n", "registers").mapInArrow(run, "band long, node long, n long")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose joint likelihood estimate does not rule the threshold out."""
    sketch, least = SetSketch(REGISTERS), PERCENT / 100 - SLACK

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                regs = [np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (2, 4)]
                keep = pa.array(sketch.jaccard(*regs, *(part.column(i).to_numpy().astype(float) for i in (3, 5))) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "na", "rb", "nb")
    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) linked by their full shingle sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*(shingle_sets(arrow_texts(batch.column(i)), WORDS) for i in (2, 3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= PERCENT * (len(x) + len(y) - both))
            release()
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def tied_neighbours(members: DataFrame) -> DataFrame:
    """(a, b) for each member of a bucket and the next larger one of its sub-bucket, and for the least ones of a bucket's sub-buckets; ``TIES`` of each larger one
    over all its buckets, as members of a large group would have another in each. No link is lost by that: buckets that still hold several components are
    compared whole."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node", "band"), F.lit(SALTS)))  # another one in each band, so that the sub-buckets overlap

    def chain(rows: DataFrame, *keys: str) -> DataFrame:
        before = F.lag(F.struct("node", "n")).over(Window.partitionBy(*keys).orderBy("n", "node"))
        return rows.select("node", "n", before.alias("before")).where(f"100 * before.n >= {PERCENT} * n")

    heads = salted.groupBy("band", "salt").agg(F.min(F.struct("n", "node")).alias("head")).select("band", "head.n", "head.node")
    pairs = chain(salted, "band", "salt").unionByName(chain(heads, "band")).select("node", F.col("before.node").alias("before")).distinct()
    drawn = Window.partitionBy("node").orderBy(F.xxhash64("node", "before"), "before")
    few = pairs.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= TIES)
    return few.select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).distinct()


def across_components(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between components of ``placed`` (band, node, n, component) whose members share a bucket, one for each a and foreign component.

    Members of buckets that hold several components are gathered by the connected groups of such buckets; a group is cut into
    parts of about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles by a hash, and each two parts meet in one task, where registers and then the
    full sets are compared. No pair leaves a task but the links found. A connected group of more than ``GROUP`` members is compared bucket by bucket
    instead, each pair in the first bucket it shares.
    """
    sketch, least = SetSketch(REGISTERS), PERCENT / 100 - SLACK
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_rows = stored(placed.join(stored(split.select("band", "low")), "band"))
    groups = connected_components(open_rows.select(F.col("component").alias("u"), F.col("low").alias("v"))).toDF("component", "grp")
    members = stored(open_rows.select("node", "n", "component").distinct().join(groups, "component"))
    size = lambda rows: rows.groupBy("grp").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    sizes = stored(size(members))
    whole = members.join(sizes.where(F.col("k") <= GROUP), "grp").withColumn("band", F.lit(-1))
    large = members.join(sizes.where(F.col("k") > GROUP).select("grp"), "grp", "left_semi").select("node")
    banded = open_rows.join(large, "node", "left_semi").select(F.col("band").alias("grp"), "node", "n", "component")
    banded = banded.join(size(banded), "grp").withColumn("band", F.shiftrightunsigned("grp", 8 * ROWS).cast("int"))
    columns = ["grp", "band", "node", "n", "component", (1 + F.greatest(F.col("k") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("parts")]
    cut = whole.select(*columns).unionByName(banded.select(*columns)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = met.select("grp", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "component")
    rows = rows.join(nodes.select("node", "registers").hint("merge"), "node").join(texts.hint("merge"), "node")  # a row counts once for Spark, however many parts it meets

    def compare(group: pa.Table) -> pa.Table:
        own, node, n, component = (group.column(c).to_numpy() for c in ("own", "node", "n", "component"))
        band = group.column("band")[0].as_py()
        regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint8).reshape(len(node), -1, ROWS)
        sets = list(shingle_sets((t.as_py() for t in group.column("text")), WORDS))
        one, two = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        found = []
        for x in one:
            y = two[(component[two] != component[x]) & (100 * np.minimum(n[two], n[x]) >= PERCENT * np.maximum(n[two], n[x])) & ((own[x] != own[two]) | (node[x] < node[two]))]
            same = (regs[y] == regs[x]).all(2)
            y = y[same.any(1) if band < 0 else same.any(1) & (same.argmax(1) == band)]
            linked = set()
            for start in range(0, len(y), 512):
                part = y[start : start + 512]
                r = regs[part].reshape(len(part), -1)
                likely = sketch.jaccard(np.broadcast_to(regs[x].ravel(), r.shape), r, np.full(len(part), float(n[x])), n[part].astype(float)) >= least
                for z in part[likely]:
                    if component[z] not in linked:
                        both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                        if 100 * both >= PERCENT * (n[x] + n[z] - both):
                            linked.add(component[z])
                            found.append((node[x], node[z]))
        release()
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("grp", "band", "i", "j").applyInArrow(compare, "a long, b long")


@settled
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_shingles, component_id, kept; see the module's text."""
    signed = stored(signatures(docs, id_col, text_col))
    keys = ["one", "two", "n_shingles"]
    nodes = stored(
        signed.where("n_shingles > 0 and id is not null")
        .groupBy(*keys)
        .agg(F.min(F.struct("id", "print")).alias("least"), F.first("registers").alias("registers"))
        .select(*keys, "least.id", "least.print", F.col("n_shingles").alias("n"), "registers", F.monotonically_increasing_id().alias("node"))
    )
    banded = band_rows(nodes)
    shared = banded.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    members = stored(stored(banded).join(stored(shared), "band", "left_semi"))
    ids = members.select("node").distinct().join(nodes.select("node", "id", "print"), "node")
    texts = stored(texts_of(docs, id_col, text_col).join(ids, ["id", "print"]).dropDuplicates(["node"]).select("node", "text"))

    chain = stored(tied_neighbours(members))
    links = stored(verified(likely(chain, nodes), texts))
    tied = stored(connected_components(links.toDF("u", "v")))

    def named(rows: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
        by = tied.toDF(node, component)
        return rows.join(by, node, "left").withColumn(component, F.coalesce(component, node))

    more = stored(across_components(named(members), nodes, texts))
    if more.isEmpty():
        final = tied
    else:
        joined = named(named(more, "a", "u"), "b", "v").select("u", "v")
        final = stored(connected_components(tied.toDF("u", "v").unionByName(joined)))
    classes = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("id").alias("least"))
    placed = classes.join(least, "component").select(*keys, "least")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return (
        signed.drop("registers")
        .join(placed, keys, "left")
        .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    )
