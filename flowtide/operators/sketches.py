"""Stored sketches that merge: quantiles of samples per hour and day, and sets of category values per split.

A quantile sketch holds some thousand numbers, whatever it has seen. Sketches of hours are merged into those of days without
a look at the samples, so a table of them answers for any span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 800  # k of a quantile sketch
SET_BITS = 14  # log2 of the values a set sketch holds exactly


def rank_error(size: int = SIZE) -> float:
    """Twice the error of a rank, as a share of all samples, that 99 % of answers of a sketch of this size keep."""
    return 2 * 2.296 / size**0.9723


def _from(at: str, seconds: int) -> Column:
    width = seconds * 1_000_000
    return (F.floor(F.col(at) / F.lit(width)) * F.lit(width)).cast("long")


def quantile_sketches(
    samples: DataFrame, keys: Sequence[str] = (), value: str = "seconds", at: str = "ts_us", seconds: int = 3600, size: int = SIZE
) -> DataFrame:
    """(keys, from_us, n, low, high, sketch) for each span; null values and NaN don't count. n, low and high are exact."""
    v = F.col(value).cast("double")
    rows = samples.where(v.isNotNull() & ~F.isnan(v)).select(*keys, _from(at, seconds).alias("from_us"), v.alias("_v"))
    return rows.groupBy(*keys, "from_us").agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.kll_sketch_agg_double("_v", F.lit(size)).alias("sketch")
    )


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = (), seconds: int = 86_400) -> DataFrame:
    """The same columns for longer spans, from the stored sketches alone."""
    longer = sketches.withColumn("from_us", _from("from_us", seconds))
    return longer.groupBy(*keys, "from_us").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketch_quantiles(sketches: DataFrame, quantiles: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, from_us, n, a column for each quantile); ranks are right to ``rank_error``, quantiles 0 and 1 exact."""
    def at(q: float) -> Column:
        return F.col("low") if q <= 0 else F.col("high") if q >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))

    return sketches.select(*keys, "from_us", "n", *[at(q).alias(name) for name, q in quantiles.items()])


def rank_checks(
    answers: DataFrame, samples: DataFrame, quantiles: dict[str, float], value: str = "seconds", at: str = "ts_us", seconds: int = 86_400,
    size: int = SIZE,
) -> DataFrame:
    """(from_us, q, n, within) for answers without keys: whether an answer's true ranks come within the error of the one asked for."""
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(n).alias("answer")) for n, q in quantiles.items()]))
    each = answers.select("from_us", "n", asked.alias("a")).select("from_us", "n", "a.*")
    v = F.col(value).cast("double")
    rows = samples.where(v.isNotNull() & ~F.isnan(v)).groupBy(_from(at, seconds).alias("from_us"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    below, upto = (F.sum(F.when(c, F.col("_n")).otherwise(0)) for c in (F.col("_v") < F.col("answer"), F.col("_v") <= F.col("answer")))
    counted = rows.join(each, "from_us").groupBy("from_us", "q", "n").agg(below.alias("below"), upto.alias("upto"))
    slack = F.lit(rank_error(size)) * F.col("n") + 1
    rank = F.col("q") * F.col("n")
    return counted.select("from_us", "q", "n", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("within"))


def set_sketches(rows: DataFrame, by: str, columns: Sequence[str], bits: int = SET_BITS) -> DataFrame:
    """(by, column, n, sketch): the set of the non-null values of each text column, in one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return rows.select(by, F.inline(cells)).groupBy(by, "column").agg(
        F.count("value").alias("n"), F.theta_sketch_agg("value", F.lit(bits)).alias("sketch")
    )


def unseen_counts(sketches: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """(column, only_in, n_values): how many values only one of two stored groups has, from the sketches alone.

    Exact as long as a column has no more than 2 ** bits values, an estimate beyond. A group without rows for a column has none.
    """
    one, other = (sketches.where(F.col(by) == g).select("column", F.col("sketch").alias(n)) for g, n in ((left, "l"), (right, "r")))
    both = one.join(other, "column", "full")

    def only(a: str, b: str) -> Column:
        rest = F.when(F.col(b).isNull(), F.col(a)).otherwise(F.theta_difference(a, b))
        return F.coalesce(F.when(F.col(a).isNotNull(), F.theta_sketch_estimate(rest)), F.lit(0))

    sides = F.array(*[F.struct(F.lit(g).alias("only_in"), only(a, b).cast("long").alias("n_values")) for g, a, b in ((left, "l", "r"), (right, "r", "l"))])
    return both.select("column", F.inline(sides))
