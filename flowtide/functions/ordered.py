"""Ordered scans that no single key can overload.

A window over a key runs in one task, however large the key is. Here a key with very many rows is
first cut into ordered pieces; windows run inside a piece, and a small table with one row per piece
carries the running value from each piece to the next. Keys of ordinary size take the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.session import materialise

# Rows of one key that a single window task may sort.
HOT_ROWS = 5_000_000
# Pieces of fewer rows than this take longer to start than to sort, so a lower limit cuts no finer once there are MANY of them.
PIECE_ROWS = 250_000
MANY = 64
PIECE = "_piece"
SLOT = "_slot"


@dataclass(frozen=True)
class Lane:
    """Rows of the same keys, in order; ``piece`` numbers the ordered parts of cut keys."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    piece: str | None = None
    descending: bool = False

    def reversed(self) -> Lane:
        return replace(self, descending=not self.descending)

    @property
    def group(self) -> list[str]:
        return [*self.keys, self.piece] if self.piece else [*self.keys]

    def sorted_by(self, names: Sequence[str]) -> list[Column]:
        return [F.col(n).desc() if self.descending else F.col(n).asc() for n in names]


def _counted_hot(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """(_h, _n): hash of each key that holds more than ``limit`` rows, with its row count.

    An exact count with map-side combine; at most rows / limit keys come out of it. A hash collision
    only sends a small key along the careful route, which gives the same result.
    """
    counts = df.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > limit)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> dict[int, int]:
    """Hash and row count of the keys that hold more than ``limit`` rows; for limits that few keys exceed."""
    return {r._h: r._n for r in _counted_hot(df, keys, limit).collect()}


def pieces_for(rows: int, limit: int) -> int:
    """Pieces to cut so many rows into: half the limit each, but not ever more of them than are worth a task."""
    return max(2, min(-(-2 * rows // max(limit, 1)), max(MANY, -(-2 * rows // PIECE_ROWS))))


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary keys, rows of hot keys or None, pieces to cut the hot rows into).

    The hot keys are stored, so Spark knows their size when it joins them, and only their sum comes to the driver.
    """
    hot = materialise(_counted_hot(df, keys, limit), "hot-keys")
    rows = hot.agg(F.sum("_n")).first()[0]
    if rows is None:
        return df, None, 0
    is_hot = F.xxhash64(*keys) == hot._h
    return df.join(hot, is_hot, "left_anti"), df.join(hot, is_hot, "left_semi"), pieces_for(rows, limit)


def cut(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    pieces: int | None = None,
    name: str = "pieces",
) -> tuple[DataFrame, Lane]:
    """Range-partition rows by (keys, order) and store them with their piece and place in it.

    Range bounds are sampled, so the pieces are written once and read from then on. ``order`` must
    end in a unique column: then no value, however frequent, can fill a piece.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(pieces, *by) if pieces else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).withColumn(SLOT, F.monotonically_increasing_id())
    stored = materialise(placed, name)
    return (
        stored.withColumn(PIECE, F.shiftright(SLOT, 33).cast("int")),
        Lane(tuple(keys), tuple(order), PIECE),
    )


def in_lanes(placed: DataFrame, lane: Lane, work: Callable[[DataFrame, Lane], DataFrame], name: str) -> DataFrame:
    """``work`` over rows as ``cut`` gives them: once for the keys that lie within one piece, once for the others.

    Rows are ordered by key, so a key that goes on in the next piece is the greatest of its own piece, and there are no more of them than
    pieces. Only they have a value to carry from piece to piece; windows of the rest share one exchange and one sort, whatever ``work`` scans.
    """
    last = placed.groupBy(PIECE).agg(F.max(F.struct(*lane.keys)).alias("_k"))
    last = materialise(last.select(*[F.col(f"_k.{k}").alias(f"_last_{k}") for k in lane.keys]).distinct(), f"{name}-across")
    same = [F.col(k).eqNullSafe(F.col(f"_last_{k}")) for k in lane.keys]
    within = work(placed.join(F.broadcast(last), same, "left_anti"), replace(lane, piece=None))
    return within.unionByName(work(placed.join(F.broadcast(last), same, "left_semi"), lane))


def scan(
    df: DataFrame,
    lane: Lane,
    before: Mapping[str, Column] | None = None,
    upto: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to the rows of each key.

    ``before``: last non-null value of earlier rows; ``upto``: the same including this row;
    ``total``: running sum including this row.
    """
    before, upto, total = before or {}, upto or {}, total or {}
    window = Window.partitionBy(*lane.group).orderBy(*lane.sorted_by(lane.order))
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {n: F.last(e, ignorenulls=True).over(earlier) for n, e in before.items()}
    running |= {n: F.last(e, ignorenulls=True).over(so_far) for n, e in upto.items()}
    running |= {n: F.sum(e).over(so_far) for n, e in total.items()}
    local = df.withColumns(running)
    if lane.piece is None:
        return local

    place = F.struct(*lane.order)
    pick = F.min_by if lane.descending else F.max_by
    last_of = {n: pick(e, F.when(e.isNotNull(), place)) for n, e in (dict(before) | dict(upto)).items()}
    sum_of = {n: F.sum(e) for n, e in total.items()}
    per_piece = df.groupBy(*lane.group).agg(*[a.alias(n) for n, a in (last_of | sum_of).items()])
    # Of a key only the pieces after its first one take anything over, so there are fewer such rows than pieces.
    in_order = Window.partitionBy(*lane.keys).orderBy(*lane.sorted_by([lane.piece]))
    onward = in_order.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_piece.select(
        *[F.col(g).alias(f"_in_{g}") for g in lane.group],
        *[F.last(n, ignorenulls=True).over(onward).alias(f"_c_{n}") for n in last_of],
        *[F.sum(n).over(onward).alias(f"_c_{n}") for n in sum_of],
        F.row_number().over(in_order).alias("_nth"),
    ).where("_nth > 1").drop("_nth")
    same = [F.col(g).eqNullSafe(F.col(f"_in_{g}")) for g in lane.group]
    joined = local.join(F.broadcast(carried), same, "left")
    merged = {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in last_of}
    merged |= {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sum_of}
    return joined.withColumns(merged).select(*local.columns)


def number_rows(df: DataFrame, order: Sequence[str], out: str = "seq", start: int = 0) -> DataFrame:
    """Number the rows of the whole table in order, without a window over the whole table.

    ``order`` must end in a unique column. Rows are range-partitioned and sorted once; a row's number
    is its place in its partition plus the sizes of the partitions before it (one row per partition).
    """
    placed, lane = cut(df, (), order, name="numbered")
    sizes = placed.groupBy(PIECE).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(PIECE), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    place = F.col(SLOT).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), PIECE)
        .withColumn(out, F.col("_ahead") + place + F.lit(start))
        .drop(PIECE, SLOT, "_ahead")
    )
