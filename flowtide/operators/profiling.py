"""Data-quality profile of labelled flow tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.columns import count_when, one_row, strip
from flowtide.schemas import CATEGORICAL, DYNAMIC_RANGE, QUASI_CONSTANT, ROW_ID, TARGET, TARGET_CLASS

# Values of a column that are ranked at last, after passes that narrow the range around its median; and the passes' accuracy.
MEDIAN_VALUES, MEDIAN_ACCURACY = 10_000, 1_000


def numeric_columns(rows: DataFrame, skip: Sequence[str] = (ROW_ID, TARGET)) -> list[str]:
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def _long(one_row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide row with ``<field>__<column>`` cells to one row per column."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in columns
    ]
    return one_row.select(F.inline(F.array(*cells)))


def schema_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of either table, where they are, and whether the types agree."""
    ltypes = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    rtypes = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    names = list(dict.fromkeys([*ltypes, *rtypes]))
    rows = [(n, n in ltypes, n in rtypes, ltypes.get(n) == rtypes.get(n)) for n in names]
    return left.sparkSession.createDataFrame(rows, "column string, in_left boolean, in_right boolean, same_type boolean")


def null_counts(rows: DataFrame) -> DataFrame:
    """Columns with nulls, all counted in one pass."""
    one = rows.agg(*[count_when(F.col(c).isNull()).alias(f"nulls__{c}") for c in rows.columns])
    return _long(one, rows.columns, ["nulls"]).filter("nulls > 0")


def inf_counts(rows: DataFrame) -> DataFrame:
    """Infinite values per floating-point column, where there are any."""
    names = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.FractionalType)]
    inf = F.lit(float("inf"))
    one = rows.agg(*[count_when(F.abs(F.col(c).cast("double")) == inf).alias(f"infs__{c}") for c in names])
    return _long(one, names, ["infs"]).filter("infs > 0")


def duplicate_rows(rows: DataFrame, id_column: str | None = ROW_ID) -> DataFrame:
    """Exact duplicates, and duplicates but for the id.

    Rows are told apart by 256-bit digests of their content and id, so whole rows are never shuffled and
    copies combine before the shuffle.
    """
    content = [c for c in rows.columns if c != id_column]

    def digest(names: list[str]) -> Column:
        # JSON leaves out nulls and quotes the rest, so different rows give different texts.
        return F.unhex(F.sha2(F.to_json(F.struct(*names), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}), 256)) if names else F.lit(b"")

    ids = [id_column] if id_column in rows.columns else []
    exact = rows.select(digest(content).alias("_c"), digest(ids).alias("_i")).groupBy("_c", "_i").agg(F.count(F.lit(1)).alias("_n"))
    grouped = exact.groupBy("_c").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_exact"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return grouped.agg(
        total.alias("n_rows"), F.coalesce(F.sum("_exact"), F.lit(0)).alias("exact_duplicates"),
        extra.alias("content_duplicates"),
        F.when(total > 0, extra / total).otherwise(F.lit(0.0)).alias("content_share"),
    )


def both_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def value_counts(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows per value of each column, in one shuffle of already combined counts."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return rows.select(*by, F.inline(F.array(*cells))).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


_TEXTS = [*CATEGORICAL, TARGET_CLASS]


def category_profile(train: DataFrame, test: DataFrame, columns: Sequence[str] = _TEXTS) -> DataFrame:
    v, n = F.col("value"), F.col("n")
    return value_counts(both_splits(train, test), columns).groupBy("split", "column").agg(
        F.count("value").alias("n_distinct"),
        F.sum(F.when(v == "-", n).otherwise(0)).alias("n_placeholder"),
        F.sum(F.when(strip(v) == "", n).otherwise(0)).alias("n_blank"),
    )


def unseen_categories(train: DataFrame, test: DataFrame, columns: Sequence[str] = _TEXTS) -> DataFrame:
    """Values that only one of the splits has."""
    seen = value_counts(both_splits(train, test), columns).filter(F.col("value").isNotNull())
    sides = seen.groupBy("column", "value").agg(F.count(F.lit(1)).alias("sides"), F.min("split").alias("only_in"))
    return sides.filter("sides = 1").select("column", "value", "only_in")


def target_distribution(train: DataFrame, test: DataFrame) -> DataFrame:
    """Counts and shares of both targets per split."""
    counts = value_counts(both_splits(train, test), [TARGET, TARGET_CLASS])
    whole = Window.partitionBy("split", "column")
    return counts.select(
        "split", F.col("column").alias("target"), "value", "n", (F.col("n") / F.sum("n").over(whole)).alias("share")
    )


def label_alignment(rows: DataFrame) -> DataFrame:
    """Normal goes with 0 and every attack with 1."""
    normal = F.col(TARGET_CLASS) == "Normal"
    return rows.agg(
        F.coalesce(F.bool_and(F.when(normal, F.col(TARGET) == 0).otherwise(F.col(TARGET) == 1)), F.lit(True)).alias("aligned")
    )


def constant_columns(rows: DataFrame, quasi: float = QUASI_CONSTANT) -> DataFrame:
    """Columns in which one value (null included) has at least the given share.

    Such a value is the median of a numeric column and the top item of a text column, so one pass finds
    the candidates and a second counts them exactly; no column is shuffled. Valid for shares above half by more
    than the error of the approximate median. An empty table has no such columns.
    """
    if quasi <= 0.5 + 2 / MEDIAN_ACCURACY:
        raise ValueError(f"the share must be above one half by more than {2 / MEDIAN_ACCURACY}")
    numeric = set(numeric_columns(rows, skip=()))
    names = rows.columns

    def candidate(c: str) -> Column:
        if c in numeric:
            return F.percentile_approx(c, 0.5, MEDIAN_ACCURACY)
        return F.get(F.expr(f"approx_top_k(cast(`{c}` as string), 1, 100)"), F.lit(0))["item"]

    found = rows.agg(*[candidate(c).alias(c) for c in names]).first()

    def same(c: str) -> Column:
        value = F.col(c) if c in numeric else F.col(c).cast("string")
        return count_when(value == F.lit(found[c]))

    one = rows.agg(
        F.count(F.lit(1)).alias("_n"),
        *[same(c).alias(f"hits__{c}") for c in names],
        *[count_when(F.col(c).isNull()).alias(f"nulls__{c}") for c in names],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(f"nulls__{c}") > F.col(f"hits__{c}"), F.lit(None)).otherwise(F.lit(str(found[c]))).alias("top_value"),
            F.try_divide(F.greatest(f"hits__{c}", f"nulls__{c}"), F.col("_n")).alias("top_share"),
        )
        for c in names
    ]
    return (
        one.select(F.inline(F.array(*cells)))
        .filter(F.col("top_share") >= quasi)
        .withColumn("kind", F.when(F.col("top_share") == 1.0, "constant").otherwise("quasi_constant"))
    )


@dataclass
class _Bracket:
    """Values of one column between which the median lies."""

    n: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.n - 1) // 2, self.n // 2


_PLAIN = {"n": F.count, "lo": F.min, "hi": F.max}
_MOMENTS = {"mean": F.avg, "std": F.stddev_samp}


def _one_row(rows: DataFrame, columns: Sequence[str], stats: dict) -> Row:
    """Plain statistics of all columns in one job: one row, read to the driver."""
    return one_row(rows, [f(F.col(c).cast("double")).alias(f"{s}__{c}") for c in columns for s, f in stats.items()])


def _brackets(rows: DataFrame, columns: Sequence[str], limit: int, ends: Row) -> dict[str, _Bracket]:
    """Narrow each column to few values around its median, by passes without a shuffle of rows."""
    state = {
        c: _Bracket(ends[f"n__{c}"], ends[f"lo__{c}"], ends[f"hi__{c}"], 0, ends[f"n__{c}"])
        for c in columns
        if ends[f"n__{c}"]
    }
    wide = [c for c, b in state.items() if b.inside > limit and b.low < b.high]
    while wide:
        def within(c: str, lo: float, hi: float) -> Column:
            return F.col(c).cast("double").between(F.lit(lo), F.lit(hi))

        def shares(b: _Bracket) -> list[float]:
            lo, hi = ((r - b.below + 0.5) / b.inside for r in b.ranks)
            return [max(lo - 2 / MEDIAN_ACCURACY, 0.0), min(hi + 2 / MEDIAN_ACCURACY, 1.0)]

        cuts = rows.agg(
            *[
                F.percentile_approx(
                    F.when(within(c, state[c].low, state[c].high), F.col(c).cast("double")), shares(state[c]), MEDIAN_ACCURACY
                ).alias(c)
                for c in wide
            ]
        ).first()
        counts = rows.agg(
            *[F.count_if(F.col(c) < F.lit(cuts[c][0])).alias(f"below__{c}") for c in wide],
            *[F.count_if(within(c, cuts[c][0], cuts[c][1])).alias(f"inside__{c}") for c in wide],
        ).first()
        still = []
        for c in wide:
            b, below, inside = state[c], counts[f"below__{c}"], counts[f"inside__{c}"]
            first, last = b.ranks
            if below <= first and last < below + inside and inside < b.inside:
                state[c] = _Bracket(b.n, cuts[c][0], cuts[c][1], below, inside)
                if inside > limit and cuts[c][0] < cuts[c][1]:
                    still.append(c)
        wide = still
    return state


def exact_medians(
    rows: DataFrame, columns: Sequence[str], limit: int = MEDIAN_VALUES, ends: Row | None = None
) -> DataFrame:
    """Median of each column as (column, median), the mean of the two middle values if they differ."""
    state = _brackets(rows, columns, limit, ends or _one_row(rows, columns, _PLAIN))
    # A bracket of one value is the median: its rows, which may be most of the table, need not be looked at.
    known = [(c, (b.low + b.high) / 2.0 + 0.0) for c, b in state.items() if b.low == b.high]
    settled = rows.sparkSession.createDataFrame(known, "column string, median double")
    state = {c: b for c, b in state.items() if b.low != b.high}
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(c).cast("double").between(F.lit(b.low), F.lit(b.high)), F.col(c).cast("double")).alias("value"),
            *[F.lit(v).alias(n) for n, v in (("below", b.below), ("r1", b.ranks[0]), ("r2", b.ranks[1]))],
        )
        for c, b in state.items()
    ]
    if not cells:
        return settled
    kept = rows.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    counts = kept.groupBy("column", "value", "below", "r1", "r2").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.col("below") + F.sum("n").over(running))

    def at(rank: str) -> Column:
        hit = (F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    return settled.unionByName(placed.groupBy("column").agg(((at("r1") + at("r2")) / 2.0).alias("median")))


def numeric_summary(rows: DataFrame, columns: Sequence[str] | None = None, limit: int = MEDIAN_VALUES) -> DataFrame:
    """Minimum, maximum, exact median, mean and sample deviation of the numeric columns."""
    names = list(columns or numeric_columns(rows))
    stats = _one_row(rows, names, _PLAIN | _MOMENTS)
    table = rows.sparkSession.createDataFrame(
        [(c, *(stats[f"{s}__{c}"] for s in ("lo", "hi", "mean", "std"))) for c in names],
        "column string, min double, max double, mean double, std double",
    )
    # One row per column on either side.
    return table.join(F.broadcast(exact_medians(rows, names, limit, stats)), "column", "left").select(
        "column", "min", "max", "median", "mean", "std"
    )


def dynamic_range(summary: DataFrame, limit: float = DYNAMIC_RANGE) -> DataFrame:
    spread = F.col("max") / (F.col("median") + F.lit(1e-6))
    return summary.filter((F.col("max") > 0) & (F.col("min") >= 0) & (spread > limit)).select("column", spread.alias("spread"))


def profile_report(train: DataFrame, test: DataFrame) -> DataFrame:
    """The profile as one row of nested values, ready to be written as JSON."""
    spark: SparkSession = train.sparkSession
    sizes = spark.createDataFrame([(train.columns == test.columns, len(train.columns))], "schema_match boolean, columns_count int")

    def gathered(df: DataFrame, name: str) -> DataFrame:
        # These tables have a few rows per column of the profiled data.
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))

    parts = [
        train.agg(F.count(F.lit(1)).alias("train_rows")),
        test.agg(F.count(F.lit(1)).alias("test_rows")),
        gathered(null_counts(train), "train_null_columns"),
        gathered(null_counts(test), "test_null_columns"),
        duplicate_rows(train).select(F.col("exact_duplicates").alias("exact_duplicates_train"), F.col("content_duplicates").alias("content_duplicates_train")),
        gathered(category_profile(train, test), "categorical_columns"),
        gathered(target_distribution(train, test), "target_distribution"),
        gathered(constant_columns(train), "constant_columns"),
        gathered(dynamic_range(numeric_summary(train)), "high_dynamic_range_columns"),
    ]
    row = sizes.withColumn("_one", F.lit(1))
    for part in parts:
        row = row.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return row.drop("_one")
