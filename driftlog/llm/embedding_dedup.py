"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed seeded rotation and split into blocks of about ``BLOCK_DIMS`` dimensions. Two
vectors within squared distance D = 2 - 2 * cosine are within D / blocks in one block at least, so each block is
range-joined on a grid: a vector lies in one cell and probes the later cells that its block's ball of that budget meets (the
vectors of earlier cells probe its own), and only vectors whose block distance keeps to the budget become a pair.
The union of the candidates is verified by the exact cosine of the vectors as given, in double precision.

Defined cases: only vectors of equal, non-null labels and equal length are compared; null, empty and zero vectors and those with
null or non-finite components link with nothing; equal vectors are one node, however many rows hold them, and link
with each other; rows with a null id are counted as neighbours but name no component (theirs is null, they stay kept);
other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, settled, stored
from .shingles import mix

COSINE, BLOCK_DIMS, SEED = 0.98, 8, 11
CELL = 4.0  # a cell's width in radii of a block's budget
STEPS = 10_000  # steps of a radius to which places in a cell are rounded: 1.5 widths at most, so they keep within 16 bits
BUDGET = (STEPS + 4) ** 2  # rounding adds less than sqrt(BLOCK_DIMS) steps to a distance
GOLD = np.uint64(0x9E3779B97F4A7C15)


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: exact, and neither squares nor sums leave the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def probes(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) for the grid cells that the ball around a row of ``points`` meets, from the row's own on in the order of their numbers, and
    whether it is the row's own. Of two near rows in unlike cells one has the earlier cell, and its ball meets the other's."""
    width = CELL * radius
    home = np.floor(points / width + 0.5).astype(np.int64)
    inside = points / width + 0.5 - home
    side = np.where(inside < 0.5, -1, 1)
    gap = (np.where(inside < 0.5, inside, 1 - inside) * width) ** 2
    row, cell, left = np.arange(len(points)), home, np.full(len(points), radius * radius * (1 + 1e-9))
    own = np.ones(len(points), bool)
    for j in range(points.shape[1]):
        near = np.flatnonzero((gap[row, j] <= left) & (~own | (side[row, j] > 0)))
        moved = cell[near].copy()
        moved[:, j] += side[row[near], j]
        left = np.concatenate([left, left[near] - gap[row[near], j]])
        row, cell, own = np.concatenate([row, row[near]]), np.concatenate([cell, moved]), np.concatenate([own, np.zeros(len(near), bool)])
    return row, cell, own


def cells(nodes: DataFrame, cosine: float) -> DataFrame:
    """(cell, id, own, near, far): each vector's cells in all its blocks; the cell's key also holds label, length and block. ``near`` and ``far``
    hold the first ``BLOCK_DIMS`` coordinates from the cell's centre (zeros where it has fewer), four of 16 bits each."""

    def run(batches):
        turned: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            vectors = batch.column(2).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(i)
            for dims, at in by_length.items():
                x = np.array([vectors[i] for i in at], float)
                x = scaled(x)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turned.setdefault(dims, rotation(dims))
                x = x @ turned[dims]
                parts = np.array_split(np.arange(dims), max(1, dims // BLOCK_DIMS))
                radius = np.sqrt((2 - 2 * cosine) / len(parts)) + 1e-9
                label = mix(labels[np.array(at)] + np.uint64(dims))
                for b, part in enumerate(parts):
                    row, cell, own = probes(x[:, part], radius)
                    key = label[row] + np.uint64(b * int(GOLD) & 0xFFFFFFFFFFFFFFFF)
                    for j in range(cell.shape[1]):
                        key = mix(key + cell[:, j].astype(np.uint64) * GOLD)
                    some = part[:BLOCK_DIMS]
                    place = np.zeros((len(row), BLOCK_DIMS), "<i2")
                    place[:, : len(some)] = np.rint((x[row][:, some] / radius - CELL * cell[:, : len(some)]) * STEPS)
                    near, far = place.view("<i8").T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ids[np.array(at)][row]), pa.array(own), pa.array(near.copy()), pa.array(far.copy())],
                        names=["cell", "id", "own", "near", "far"],
                    )

    return nodes.select("id", F.xxhash64("label").alias("label"), "embedding").mapInArrow(run, "cell long, id long, own boolean, near long, far long")


def candidates(found: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of ``cells`` that meet in a cell and keep to the block's budget."""
    build = found.where("own").select("cell", F.col("id").alias("b"), F.col("near").alias("b_near"), F.col("far").alias("b_far"))
    at = lambda c, j: f"shiftright(shiftleft({c}, {48 - 16 * j}), 48)"
    apart = [f"({at(c, j)} - {at('b_' + c, j)})" for c in ("near", "far") for j in range(4)]
    close = f"{' + '.join(f'{d} * {d}' for d in apart)} <= {BUDGET}"
    met = found.withColumnRenamed("id", "a").join(build, "cell").where(f"a <> b and (not own or a < b) and {close}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of equal label and length whose exact cosine reaches the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 4096):
                x, y = (batch.column(i).slice(start, 4096) for i in (2, 3))
                dims = np.diff(x.offsets.to_numpy())
                same = dims == np.diff(y.offsets.to_numpy())
                for u, v, ok in zip(x, y, same) if len(set(dims)) > 1 or not same.all() else ():
                    u, v = scaled(np.array(u.as_py(), float)), scaled(np.array(v.as_py(), float))
                    keep.append(bool(ok) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= cosine)
                if len(set(dims)) == 1 and same.all():
                    u, v = (scaled(np.asarray(c.flatten().to_numpy(), float).reshape(len(c), -1)) for c in (x, y))
                    keep += ((u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)) >= cosine).tolist()
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda x: nodes.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"), F.col("embedding").alias(f"v{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("la = lb").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


@settled
def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept per row; see the module's text."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    print_of = F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ",").cast("binary"), 256))
    keyed = stored(rows.withColumn("print", print_of))
    grouped = keyed.where("print is not null").groupBy("label", "print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    nodes = stored(grouped.withColumn("id", F.coalesce("vec_id", -1 - F.abs(F.xxhash64("label", "print")))))
    pairs = candidates(stored(cells(nodes, cosine)))
    links = stored(verified(pairs, nodes, cosine))
    sized = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sized, "b").groupBy(F.col("a").alias("id")).agg(F.sum("nb").alias("beside"))
    named = nodes.where("vec_id is not null").select("id")
    classes = connected_components(links.toDF("u", "v"))
    low = classes.join(named, F.col("node") == F.col("id"), "left_semi").groupBy("component").agg(F.min("node").alias("least"))
    known = (
        nodes.join(degree, "id", "left")
        .join(classes.join(low, "component").select(F.col("node").alias("id"), "least"), "id", "left")
        .select("label", "print", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("links"), F.coalesce("least", "vec_id").alias("least"))
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return keyed.join(known, ["label", "print"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
