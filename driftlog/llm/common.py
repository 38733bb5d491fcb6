"""Shared helpers of the training-data operators: tables in the shared folder, connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SALTS = 16
BROADCAST_ROWS = 250_000  # rows of two numbers that a join may send to every task (a few MB); larger sides are dealt out with salts
PACKED = 32  # bytes of a row in a join's hash table to one in a compressed file of numbers, about; Spark takes a file's size for its rows' otherwise
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary one, a cluster an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="driftlog-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftlog-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftlog_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of ``stored()`` that no later plan reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._driftlog_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def settled(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Decorates a function of a DataFrame or a session, its first argument, that returns a DataFrame: its result is stored, and the tables stored on the way
    there are deleted. Meanwhile a file counts ``PACKED`` times its size, so that no join takes a table of millions of well compressed rows for one to broadcast:
    those would all go through the driver."""

    @functools.wraps(build)
    def run(*args, **kwargs) -> DataFrame:
        first = args[0] if args else next(iter(kwargs.values()))
        conf = getattr(first, "sparkSession", first).conf
        before = conf.get("spark.sql.sources.fileCompressionFactor")
        conf.set("spark.sql.sources.fileCompressionFactor", str(max(float(before), PACKED)))
        try:
            return settled_result(*args, **kwargs)
        finally:
            conf.set("spark.sql.sources.fileCompressionFactor", before)

    def settled_result(*args, **kwargs) -> DataFrame:
        _scratch.append([])
        try:
            out, kept = build(*args, **kwargs), _scratch[-1]
            _scratch[-1] = []
            out = stored(out)
        except BaseException:
            _scratch.pop()
            raise
        _scratch.pop()
        if _scratch:
            _scratch[-1].append(out)
        for table in kept:
            forget(table)
        return out

    return run


def arrow_texts(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column one by one, null as empty: no copy of the whole batch is made."""
    for value in column:
        yield value.as_py() or b""


def release() -> None:
    """Gives freed Arrow memory back, so that a reused Python worker does not keep the peak of its largest batch."""
    pa.default_memory_pool().release_unused()


def dealt(big: DataFrame, small: DataFrame, on: list[str], rows: int, spread: Column, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` of ``rows`` rows, unique in ``on``, where a few keys may hold most rows of ``big``.

    A small side of a checked size is broadcast; a larger one meets ``big`` under ``SALTS`` salts of each key, so that no key is
    one task's work. The join is told to sort: Spark takes the salted rows for as many as before the salts, and would broadcast all of them.
    """
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*on, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the smallest node reachable.

    Alternates large-star and small-star steps, so that chains and stars of any size settle in a logarithmic
    number of rounds. Only minima are gathered per node, and a node with many neighbours is dealt out over salts,
    never one group in one task. Nulls and self-loops are ignored; no edges give no rows.
    """

    def ends(*pairs: tuple[str, str]) -> Column:
        return F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs)))

    def star(pairs: DataFrame, rows: int) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return dealt(pairs, least, ["u"], 2 * rows, F.col("v"))

    def marked(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        """The distinct pairs, stored, with their count and a sum over them, which the write takes along."""
        seen = Observation()
        table = stored(pairs.distinct().observe(seen, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("sum")))
        return table, (seen.get["n"], seen.get["sum"])

    now, before = marked(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while True:
        large = star(now.select(ends(("u", "v"), ("v", "u"))), before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now, after = marked(star(large, before[0]).select(ends(("u", "m"), ("v", "m"))).where("u > v"))
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
