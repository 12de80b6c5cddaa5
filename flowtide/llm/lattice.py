"""Near-duplicate vectors by lattice hashing (op2).

Each table turns a unit vector by random orthogonal axes, cuts BLOCKS groups of eight coordinates out of it
and takes the nearest point of the E8 lattice for each group, moved by a random offset. The points of all groups
are a vector's cell. A vector also looks into cells in which one point is replaced by one of the
lattice neighbours that are nearest next. What meets in a cell is verified by its cosine in double precision.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import scan, stored
from flowtide.llm.graph import components

# With these the recall at a cosine of exactly 0.95 in 64 dimensions is 0.99 and rises quickly above it.
TABLES, BLOCKS, SCALE, PROBES = 16, 3, 1.2, 2
LEAST_COSINE = 0.95


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two whole ones, or eight halves with an even number of minus signs."""
    whole = [
        [s if k == i else t if k == j else 0 for k in range(8)]
        for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)
    ]
    halves = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + halves, float)


ROOTS = roots()


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight: the better of its two cosets of even whole vectors."""

    def even(y: np.ndarray) -> np.ndarray:
        point = np.rint(y)
        rest = y - point
        worst, rows = np.abs(rest).argmax(-1), np.arange(len(y))
        odd = point.sum(-1) % 2 != 0
        point[rows, worst] += np.where(rest[rows, worst] >= 0, 1, -1) * odd
        return point

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


class Tables:
    """The random axes and offsets of all tables for vectors of one length, and the cells in them."""

    def __init__(self, length: int, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = 11):
        self.size = max(8, length)  # shorter vectors are filled up with zeros
        self.blocks = max(1, min(blocks, self.size // 8))
        draw = np.random.default_rng([seed, length])
        self.axes, self.offsets = [], []
        for _ in range(tables):
            axes = np.linalg.qr(draw.standard_normal((self.size, self.size)))[0][:, : 8 * self.blocks]
            self.axes.append(axes * scale * np.sqrt(self.size / 8))
            self.offsets.append(draw.random(8 * self.blocks) * 2)
        self.mix = draw.integers(-(2**62), 2**62, (self.blocks, 8)) | 1

    def cells(self, units: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
        """A row of cell numbers for each vector: its own cell first, then those it also looks into."""
        if units.shape[1] < self.size:
            units = np.pad(units, ((0, 0), (0, self.size - units.shape[1])))
        at = (units @ self.axes[table] + self.offsets[table]).reshape(len(units), self.blocks, 8)
        parts, moved = [], []
        for k in range(self.blocks):
            point = nearest(at[:, k])
            toward = (at[:, k] - point) @ ROOTS.T  # a neighbour is the nearer, the greater this is
            best = np.argpartition(-toward, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(units), 0), int)
            number = lambda p: ((2 * p).astype(np.int64) * self.mix[k]).sum(-1)  # noqa: B023,E731
            parts.append(number(point))
            moved.append(number(point[:, None, :] + ROOTS[best]) - parts[-1][:, None])
        own = np.sum(parts, axis=0)
        return np.concatenate([own[:, None], *[own[:, None] + m for m in moved]], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _cells(vectors: DataFrame) -> DataFrame:
    """(r, own, t, cell) for vectors (r, v)."""

    def build():
        known: dict[int, Tables] = {}

        def step(batch):
            lengths = np.array([len(v) for v in batch.column("v")])
            numbers = batch.column("r").to_numpy()
            for length in np.unique(lengths).tolist():
                tables = known.setdefault(length, Tables(length))
                chosen = lengths == length
                x = matrix(batch.column("v").filter(pa.array(chosen)))
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for t in range(TABLES):
                    cells = tables.cells(x, t)
                    own = np.zeros(cells.shape, bool)
                    own[:, 0] = True
                    yield {
                        "r": np.repeat(numbers[chosen], cells.shape[1]), "own": own.ravel(),
                        "t": np.full(cells.size, t * 100_000 + length), "cell": cells.ravel(),
                    }

        return step

    return scan(vectors, build, "r long, own boolean, t long, cell long")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, u, v) whose vectors u and v have a cosine of at least ``least``."""

    def build():
        def step(batch):
            u, v = [c.flatten().to_numpy().astype(float) for c in (batch.column("u"), batch.column("v"))]
            size = np.array([len(x) for x in batch.column("u")])
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            top = [np.repeat(np.maximum.reduceat(np.abs(w), at), size) for w in (u, v)]
            u, v = u / top[0], v / top[1]
            dot, uu, vv = (np.add.reduceat(w, at) for w in (u * v, u * u, v * v))
            good = dot / (np.sqrt(uu) * np.sqrt(vv)) >= least
            yield {k: batch.column(k).filter(pa.array(good)) for k in ("a", "b")}

        return step

    return scan(pairs, build, "a long, b long")


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE
) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row: what is linked by a cosine of at least ``least``.

    n_links counts the other rows linked directly, equal ones too; component_id is the least key reachable by links, itself included;
    kept: whether that is the row's own key. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, nor do vectors of different lengths. Equal vectors are worked on once and need not be unit vectors.
    Keys may repeat; a null key is never the least unless there is no other, and is not kept unless it is alone.
    """
    sound = (
        F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists(vector, lambda x: x != 0)
    sure = F.when(F.coalesce(sound, F.lit(False)), F.col(vector).cast("array<double>"))
    rows = stored(rows.select(F.col(key), sure.alias("v")).withColumn("n", F.monotonically_increasing_id()), "vectors")
    one = stored(
        rows.where("v is not null").groupBy("v").agg(F.min("n").alias("r"), F.count("*").alias("m"), F.min(key).alias("least")), "distinct"
    )
    cells = stored(_cells(one.select("r", "v")), "cells")
    own = cells.where("own").select("t", "cell", F.col("r").alias("x"))
    met = cells.join(own, ["t", "cell"]).where("r <> x").select(F.least("r", "x").alias("a"), F.greatest("r", "x").alias("b"))
    met = stored(met.distinct(), "met")
    pairs = met.join(one.select(F.col("r").alias("a"), F.col("v").alias("u")), "a")
    pairs = pairs.join(one.select(F.col("r").alias("b"), "v"), "b").select("a", "b", "u", "v")
    links = stored(_verified(pairs, least), "links")
    weight = one.select(F.col("r").alias("b"), "m")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = stored(both.join(weight, "b").groupBy(F.col("a").alias("r")).agg(F.sum("m").alias("k")), "degree")
    found = stored(components(links), "components")
    root = one.join(found, one.r == found.node, "left").select("r", "v", "m", "least", F.coalesce("root", "r").alias("root"))
    root = stored(root, "roots")
    least_of = stored(root.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = root.join(least_of, "root").join(degree, "r", "left").select(
        "v", "component_id", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("n_links")
    )
    named = stored(named, "named")
    out = rows.join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col(key).eqNullSafe(component).alias("kept"),
    )
