"""Whitening of embeddings by bit-sliced scatter (op13).

Components are turned into integers, ``floor(SCALE * c) + BIAS``. A task gathers blocks of rows; in a block every
dimension, less its least value there, is cut into bit planes, and each plane is packed into words of 64 rows. The
cross-product of two dimensions is the sum over their planes a, b of ``2**(a + b) * popcount(plane_a & plane_b)``: exact, and
with planes only as many as the values need. Blocks meet as sums of 32-bit digits, a few rows for each pair of dimensions and block.

The scatter is centred as integers, ``n * sum(x y) - sum(x) * sum(y)``, and only then becomes floating point for ``eigh``.
The driver holds dimension x dimension numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import scan, spare, stored

SCALE, BIAS = 64, 1_000_000
COMPONENTS = 32
BLOCK = 1 << 15  # rows whose planes are in memory at once
LARGEST = 1 << 56  # entries of this size don't become a long
DIGIT = 32  # bits of a digit of the sums

_SUMS = "i int, j int, digit int, total long"


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has entries, all of them finite and no null, and the most common length (of equal ones, the longest).

    Entries of LARGEST or more in size, which are no long after scaling, count as not finite.
    """
    good = F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float(LARGEST)) & ~F.isnan(x.cast("double")), F.lit(False))),
        F.lit(False),
    )
    found = df.where(good)
    sizes = found.groupBy(F.size(vector).alias("d")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size(vector) == (most["d"] if most else 0))


def as_integers(column: pa.Array, dimension: int) -> np.ndarray:
    """floor(SCALE * c) of a column of vectors, without the bias."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dimension)


def planes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension of each plane, weight exponent of each plane) of non-negative integers, 64 rows to a word."""
    rows, dimension = block.shape
    words, which, power = [], [], []
    for d in range(dimension):
        for bit in range(int(block[:, d].max()).bit_length()):
            bits = np.zeros(-(-rows // 64) * 64, np.uint8)
            bits[:rows] = (block[:, d] >> bit) & 1
            words.append(np.packbits(bits).view(np.uint64))
            which.append(d)
            power.append(bit)
    packed = np.stack(words) if words else np.zeros((0, 0), np.uint64)
    return packed, np.array(which, np.int64), np.array(power, np.int64)


def cross_products(block: np.ndarray) -> list[list[int]]:
    """Sums of x_i * x_j over the rows of a block of non-negative integers, exact."""
    dimension = block.shape[1]
    words, which, power = planes(block)
    total = [[0] * dimension for _ in range(dimension)]
    for a in range(len(which)):
        counts = np.bitwise_count(words[a] & words[a:]).sum(axis=1, dtype=np.int64)
        # Planes of one dimension follow one another, so its weighted counts are one slice.
        i = int(which[a])
        starts = np.flatnonzero(np.r_[True, which[a + 1 :] != which[a:-1]])
        ends = [*starts[1:].tolist(), len(counts)]
        for s, e in zip(starts.tolist(), ends):
            j = int(which[a + s])
            weighted = sum(int(c) << int(p) for c, p in zip(counts[s:e], power[a + s : a + e])) << int(power[a])
            if j == i:  # the planes a < b of one dimension count twice, a with itself once
                weighted = 2 * weighted - (int(counts[0]) << (2 * int(power[a])))
            total[i][j] += weighted
    return total


def _summed(dimension: int):
    """Rows (i, j, sum of x_i x_j) and (i, -1, sum of x_i) and (-1, -1, n) of each block, without the bias."""

    def build():
        held: list[np.ndarray] = []

        def flush() -> Iterator[dict]:
            if not held:
                return
            rows = np.concatenate(held)
            held.clear()
            low = rows.min(axis=0)
            n, shift = len(rows), [int(v) for v in low]
            block = rows - low
            sums = [int(v) for v in block.sum(axis=0, dtype=np.int64 if int(block.max()) < 1 << 47 else object)]
            cross = cross_products(block)
            out = [(-1, -1, n)]
            out += [(i, -1, sums[i] + n * shift[i]) for i in range(dimension)]
            for i in range(dimension):
                for j in range(i, dimension):
                    out.append((i, j, cross[i][j] + shift[i] * sums[j] + shift[j] * sums[i] + n * shift[i] * shift[j]))
            i, j, digit, total = zip(*((i, j, k, d) for i, j, v in out for k, d in _digits(v)))
            yield {"i": i, "j": j, "digit": digit, "total": total}

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            if batch.num_rows:
                held.append(as_integers(batch.column(0), dimension))
            if sum(map(len, held)) >= BLOCK:
                yield from flush()

        return step, flush

    return build


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer of any size, the sign on each digit; at least one."""
    sign, left, place = (-1 if value < 0 else 1), abs(value), 0
    while left or not place:
        yield place, sign * (left & ((1 << DIGIT) - 1))
        left >>= DIGIT
        place += 1


@dataclass(frozen=True)
class Whitening:
    """n vectors, the sums of their integers without the bias, and the components: directions, values, shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimension x components
    values: np.ndarray
    explained: np.ndarray

    @property
    def scaled(self) -> np.ndarray:
        """Directions over the root of their value; a direction without variance is all zero."""
        flat = ~(self.values > 0)
        return np.where(flat, 0.0, self.vectors / np.sqrt(np.where(flat, 1.0, self.values)))


def scatter(rows: DataFrame, vector: str, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums and the cross-products of the integers (without the bias), exact."""
    sums = scan(rows.select(vector), _summed(dimension), _SUMS).groupBy("i", "j", "digit").agg(F.sum("total").alias("total"))
    found = defaultdict(int)
    for r in sums.collect():  # a few rows for each pair of dimensions
        found[r["i"], r["j"]] += r["total"] << (DIGIT * r["digit"])
    cross = [[found[min(i, j), max(i, j)] for j in range(dimension)] for i in range(dimension)]
    return found[-1, -1], [found[i, -1] for i in range(dimension)], cross


def solve(n: int, sums: list[int], cross: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """Unit eigenvectors of the covariance by falling eigenvalue.

    The first entry of a vector that is not almost zero is positive. Eigenvalues within the rounding of the largest one are zero.
    """
    dimension = len(sums)
    centred = [[n * cross[i][j] - sums[i] * sums[j] for j in range(dimension)] for i in range(dimension)]
    covariance = np.array([[value / (n * n) for value in row] for row in centred], float)  # the only rounding
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    noise = dimension * np.finfo(float).eps * max(float(values[0]), 0.0) if len(values) else 0.0
    values = np.where(values > noise, values, 0.0)
    lead = [next((x for x in v if abs(x) > 1e-9), 1.0) for v in vectors.T]
    trace = sum(centred[i][i] for i in range(dimension)) / (n * n)
    return Whitening(n, sums, vectors * np.sign(lead), values, values / trace if trace else np.zeros(len(values)))


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Sum over dimensions of (n * x - S) ** 2 of each row, exact."""
    most = max((abs(s) for s in model.sums), default=0)
    largest = model.n * int(np.abs(x).max(initial=0)) + most
    exact = x.dtype if x.shape[1] * largest * largest < 1 << 63 else object
    apart = x.astype(exact) * model.n - np.array(model.sums, exact)
    return [int(v) for v in (apart * apart).sum(axis=1)]


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows: x - S / n on the components, over the roots of their values."""
    mean = [divmod(s, model.n) for s in model.sums]
    whole, part = np.array([m for m, _ in mean], np.int64), np.array([r / model.n for _, r in mean])
    return ((x - whole).astype(float) - part) @ model.scaled


def _moments(model: Whitening, dimension: int):
    """Sums of the whitened rows and of their products, a task at a time."""
    k = len(model.values)

    def build():
        total, n = np.zeros((k + 1, k + 1)), 0

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            if not batch.num_rows:
                return
            white = project(as_integers(batch.column(0), dimension), model)
            total[:k, :k] += white.T @ white
            total[k, :k] += white.sum(axis=0)
            yield from ()

        def finish() -> Iterator[dict]:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield {"i": i.astype(np.int32), "j": j.astype(np.int32), "total": total.ravel()}

        return step, finish

    return build


def identity_error(rows: DataFrame, vector: str, dimension: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' own covariance minus the identity, over components with variance."""
    k = len(model.values)
    sums = scan(rows.select(vector), _moments(model, dimension), "i int, j int, total double")
    got = np.zeros((k + 1, k + 1))
    for r in sums.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # components ** 2 rows
        got[r["i"], r["j"]] = r["total"]
    mean = got[k, :k] / model.n
    live = model.values > 0
    apart = (got[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]
    return float(np.abs(apart).max(initial=0.0))


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row of df and component, with the columns of df but for the vector, whatever their names, and

    component (from 1, by falling variance), n, deviation (decimal(38,0), null beyond it: sum over dimensions of (n * x - S) ** 2), whitened,
    explained (share of the trace) and identity_error.

    Left out are null and empty vectors, those with a null or non-finite entry, and those of another length than the most
    common one. Repeated rows count as often as they occur. A component without variance has whitened and explained 0 and
    takes no part in identity_error; so do all of a single row. An empty table gives an empty result.
    """
    own = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    rest = [c for c in df.columns if c != vector and c not in own]
    made = spare(df, "made_")
    rows = stored(usable(df.select(*rest, vector), vector), "vectors")
    first = rows.select(F.size(vector).alias("d")).first()
    schema = "array<struct<component:int,n:bigint,deviation:decimal(38,0),whitened:double,explained:double,identity_error:double>>"
    if first is None:
        nothing = rows.select(*rest, F.lit(None).cast(schema).alias(made))
        return nothing.select(*rest, F.inline(made))
    dimension = first["d"]
    model = solve(*scatter(rows, vector, dimension), components)
    error = identity_error(rows, vector, dimension, model)

    @F.pandas_udf("struct<deviation:decimal(38,0),whitened:array<double>>")
    def measured(vectors):
        x = as_integers(pa.array(vectors), dimension)
        exact = [Decimal(v) if v < 10**38 else None for v in deviations(x, model)]
        return pd.DataFrame({"deviation": exact, "whitened": list(project(x, model))})

    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    found = rows.select(*rest, measured(vector).alias(made)).select(
        *rest, f"{made}.deviation", F.posexplode(F.arrays_zip(F.col(f"{made}.whitened").alias("w"), shares.alias("e"))).alias("component", made)
    )
    return found.select(
        *rest, (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col(f"{made}.w").alias("whitened"), F.col(f"{made}.e").alias("explained"), F.lit(error).alias("identity_error"),
    )
