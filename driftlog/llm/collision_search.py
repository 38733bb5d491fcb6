"""Nearest neighbours by cosine, by counting collisions of single projections around each query.

Unit vectors are projected on ``PROJECTIONS`` or more fixed seeded directions; an index block holds each projection's values in one sorted array. A query opens a window
around its own value in every array and widens all windows together, radius by radius (virtual rehashing: the arrays stay as they are, only places
beyond the last window are counted). A vector that lies within a radius meets a window of that half width with a known chance, so those met in at least
the ``needed`` share of the arrays are verified by their exact cosine. The search ends once the radius passes the distance of the worst neighbour
held; at the largest radius every vector has been met, so there is no case without an answer.

Vectors are dealt over blocks of about ``BLOCK`` rows by a hash, queries over blocks of about ``QUERIES``; each two blocks meet in one task. A query is first
asked in one block; the distance of its last neighbour there bounds the radius in all others. Only neighbours within that bound leave a task.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components take no part, as queries or candidates; vectors of unlike
length are not compared; each row whose id is divisible by ``every`` is a query of its own (a null id is none), and any row but itself, rows
of its own id and copies included, may be its neighbour; ties go to the smaller id, a null id last; where there are fewer candidates than asked for, all
are found; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored
from .embedding_dedup import scaled

PROJECTIONS, SEED = 64, 29
MISSED = 1.25  # standard deviations of the share of arrays met, below its mean, that a vector at the radius itself may lie
START, WIDER, WHOLE = 0.2, 1.35, 2.0  # the first radius, the growth, and the largest distance of unit vectors
BLOCK, QUERIES = 16_384, 1_024
FOUND = "query_row long, query_id long, vec_id long, score double"


@functools.lru_cache(4)
def directions(dims: int) -> np.ndarray:
    """Whole rotations side by side, scaled so that a difference of norm d has projections of variance d * d."""
    random = np.random.default_rng(SEED)
    turns = [np.linalg.qr(random.normal(size=(dims, dims)))[0] for _ in range(-(-PROJECTIONS // dims))]
    return np.concatenate(turns, 1) * np.sqrt(dims)


@functools.lru_cache(4)
def needed(dims: int) -> int:
    """How many windows as wide as the radius a vector at that distance meets, but for ``MISSED``."""
    if dims == 1:
        return directions(1).shape[1]
    random = np.random.default_rng(SEED)
    one, others = random.normal(size=400_000), random.chisquare(dims - 1, 400_000)
    share, m = float((one * one * dims <= one * one + others).mean()), directions(dims).shape[1]
    return max(1, int(np.floor(m * share - MISSED * np.sqrt(m * share * (1 - share)))))


class Block:
    """The sorted projections of some vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        projected = (self.vectors / self.norms[:, None]) @ directions(vectors.shape[1])
        self.order = np.argsort(projected.T, 1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(projected.T, self.order, 1)

    def cosines(self, query: np.ndarray, norm: float, at: np.ndarray) -> np.ndarray:
        return (self.vectors[at] * query).sum(1) / (self.norms[at] * norm)

    def nearest(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, limits: np.ndarray, k: int) -> list[list[tuple[float, int, int]]]:
        """For each query (-cosine, id, place) of the k nearest found within its limit. ``own`` is its own place in the block or -1, ``ids`` break ties."""
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(1))
        at = (queries / norms[:, None]) @ directions(queries.shape[1])
        m, n = self.values.shape
        low = np.stack([np.searchsorted(self.values[j], at[:, j]) for j in range(m)], 1)
        high = low.copy()
        met = np.zeros((len(queries), n), np.uint16)
        held: list[list[tuple[float, int, int]]] = [[] for _ in queries]
        done = np.zeros((len(queries), n), bool)
        done[np.flatnonzero(own >= 0), own[own >= 0]] = True
        active, radius, least = np.arange(len(queries)), np.minimum(START, limits), needed(queries.shape[1])
        while len(active):
            near, far = at[active] - radius[active, None], at[active] + radius[active, None]
            whole = radius[active] >= WHOLE
            first = np.stack([np.searchsorted(self.values[j], near[:, j], "left") for j in range(m)], 1)
            last = np.stack([np.searchsorted(self.values[j], far[:, j], "right") for j in range(m)], 1)
            going = []
            for i, q in enumerate(active.tolist()):
                if whole[i]:
                    new = np.flatnonzero(~done[q])
                else:
                    a, b, c, d = first[i].tolist(), low[q].tolist(), high[q].tolist(), last[i].tolist()
                    some = [self.order[j, a[j] : b[j]] for j in range(m) if a[j] < b[j]] + [self.order[j, c[j] : d[j]] for j in range(m) if c[j] < d[j]]
                    if some:
                        met[q] += np.bincount(np.concatenate(some), minlength=n).astype(np.uint16)
                    low[q], high[q] = first[i], last[i]
                    new = np.flatnonzero((met[q] >= least) & ~done[q])
                if len(new):
                    done[q, new] = True
                    score = self.cosines(queries[q], norms[q], new)
                    if len(new) > k:
                        keep = score >= np.partition(score, -k)[-k]
                        new, score = new[keep], score[keep]
                    held[q] = sorted(held[q] + list(zip((-score).tolist(), ids[new].tolist(), new.tolist())))[:k]
                reach = radius[q]
                worst = np.sqrt(max(0.0, 2 + 2 * held[q][-1][0])) if len(held[q]) == k else WHOLE
                if not whole[i] and reach < min(worst, limits[q]):
                    radius[q] = min(reach * WIDER, limits[q])
                    going.append(q)
            active = np.array(going, np.int64)
        return held


def met_blocks(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``FOUND``: each query's nearest in each block that it names. ``rows`` has dims, block, row, vec_id, embedding; ``queries`` dims, block, group, row, vec_id, embedding and ``floor``, the score that others must reach (or null)."""
    last = np.iinfo(np.int64).max

    def vectors(table: pa.Table) -> np.ndarray:
        column = table.column("embedding").combine_chunks()
        return np.asarray(column.flatten().to_numpy(), float).reshape(len(column), -1)

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and asked.num_rows:
            ids = candidates.column("vec_id").fill_null(last).to_numpy()
            place = {r: i for i, r in enumerate(candidates.column("row").to_pylist())}
            rows, names, floors = (asked.column(c).to_pylist() for c in ("row", "vec_id", "floor"))
            limits = np.array([WHOLE if s is None else min(WHOLE, np.sqrt(max(0.0, 2 - 2 * s)) + 1e-6) for s in floors])
            own = np.array([place.get(r, -1) for r in rows])
            for row, name, floor, found in zip(rows, names, floors, Block(vectors(candidates)).nearest(vectors(asked), own, ids, limits, k)):
                out += [(row, name, i if i < last else None, -s) for s, i, _ in found if floor is None or -s >= floor]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("query_row", "query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    keys = ["dims", "block", "group"]
    placed = rows.join(queries.select(*keys).distinct(), ["dims", "block"])
    anew = lambda side: side.select(*(F.col(c).alias(c) for c in side.columns))  # noqa: E731  both sides come from one table
    return anew(placed).groupBy(*keys).cogroup(anew(queries).groupBy(*keys)).applyInArrow(search, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@settled
def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score; see the module's text."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = stored(kept.where(F.coalesce(sound, F.lit(False))).withColumns({"row": F.monotonically_increasing_id(), "dims": F.size("embedding")}))
    asked = F.col("vec_id") % every == 0
    n, n_asked = rows.agg(F.count("*"), F.count_if(asked)).first()
    blocks, groups = 1 + n // BLOCK, 1 + n_asked // QUERIES
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    queries = rows.where(asked).withColumn("group", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(groups)).cast("int"))
    home = F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(blocks)).cast("int")
    first = stored(met_blocks(dealt, queries.withColumns({"block": home, "floor": F.lit(None).cast("double")}), k))
    if blocks == 1:
        return ranked(first, k).select("query_id", "rank", "vec_id", "score")
    bound = ranked(first, k).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != home)
    limited = queries.withColumn("block", F.explode(others)).join(bound, "row", "left")
    return ranked(first.unionByName(met_blocks(dealt, limited, k)), k).select("query_id", "rank", "vec_id", "score")
