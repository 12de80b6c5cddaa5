"""Rates, increases and quantiles of scraped counters.

Samples are (ts_us, value) of series given by key columns; a counter only grows, unless its process starts again at zero. A
window ends at a multiple of the step, holds the samples of the range before its end (end included, start not), and has a
result if it holds two or more. Its increase is that from first to last sample, with every fall taken as a start at zero, and
is extrapolated to the window's ends: by as much as is missing, but by half an average gap where more than 1.1 gaps are
missing, and at the start by no more than would take the counter below zero.

Samples are summed per series and step first, so windows that overlap share that work. Series that are too long for one task are
cut into pieces by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.ordered import HOT_ROWS, PIECE, SLOT, Lane, cut, scan, split_hot

SECOND_US = 1_000_000
_ORDER = ("ts_us", "value")


def _grown(samples: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Samples with ``grown``: the increase since the sample before (0 for the first one)."""
    rows = samples.where("ts_us is not null and value is not null and not isnan(value)").select(*keys, *_ORDER)
    if not keys:  # all samples are one series
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    before = {"_before": F.col("value")}
    usual, hot, pieces = split_hot(rows, keys, hot_rows)
    out = scan(usual, Lane(tuple(keys), _ORDER), before=before)
    if hot is not None:
        cut_rows, lane = cut(hot, keys, _ORDER, pieces, "samples")
        out = out.unionByName(scan(cut_rows, lane, before=before).drop(PIECE, SLOT))
    since, value = F.col("_before"), F.col("value")
    return out.withColumn("grown", F.when(since.isNull(), 0.0).when(value < since, value).otherwise(value - since)).drop("_before")


def _windows(samples: DataFrame, keys: Sequence[str], seconds: int, step: int, hot_rows: int) -> DataFrame:
    """Per series and window: number, first and last time, first value, increase between first and last."""
    if seconds % step:
        raise ValueError("the range must be a multiple of the step")
    step_us, steps = step * SECOND_US, seconds // step
    # The step whose end is at or after the sample.
    of_step = (F.floor((F.col("ts_us") - 1) / F.lit(step_us)) + 1).alias("_s")
    at = F.struct("ts_us", "value")
    first = F.min(F.struct("ts_us", "value", "grown")).alias("f")
    per = _grown(samples, keys, hot_rows).groupBy(*keys, of_step).agg(
        F.count(F.lit(1)).alias("n"), first, F.max(at).alias("l"), F.sum("grown").alias("g")
    )
    spread = per.withColumn("_w", F.explode(F.sequence(F.col("_s"), F.col("_s") + F.lit(steps - 1))))
    per_window = spread.groupBy(*keys, (F.col("_w") * step_us).alias("window_us")).agg(
        F.sum("n").alias("n"), F.min("f").alias("f"), F.max("l").alias("l"), F.sum("g").alias("g")
    )
    return per_window.where("n >= 2").select(
        *keys, "window_us", "n", F.col("f.ts_us").alias("first_us"), F.col("l.ts_us").alias("last_us"),
        F.col("f.value").alias("first_value"), (F.col("g") - F.col("f.grown")).alias("grown"),
    ).where("last_us > first_us")


def _extrapolated(seconds: int) -> Column:
    """The increase over the whole window."""
    sampled = F.col("last_us") - F.col("first_us")
    gap = sampled / (F.col("n") - 1)
    to_start = F.col("first_us") - (F.col("window_us") - seconds * SECOND_US)
    to_end = F.col("window_us") - F.col("last_us")
    half = gap / 2
    start = F.when(to_start >= gap * 1.1, half).otherwise(to_start.cast("double"))
    to_zero = F.when((F.col("grown") > 0) & (F.col("first_value") >= 0), sampled * (F.col("first_value") / F.col("grown")))
    start = F.when(to_zero < start, to_zero).otherwise(start)
    end = F.when(to_end >= gap * 1.1, half).otherwise(to_end.cast("double"))
    return F.col("grown") * ((sampled + start + end) / sampled)


def counter_increase(samples: DataFrame, keys: Sequence[str], seconds: int = 60, step: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, window_us, increase); window_us is the window's end. Samples without time or value don't count."""
    found = _windows(samples, keys, seconds, step, hot_rows)
    return found.select(*keys, "window_us", _extrapolated(seconds).alias("increase"))


def counter_rate(samples: DataFrame, keys: Sequence[str], seconds: int = 30, step: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, window_us, rate): the increase per second."""
    found = counter_increase(samples, keys, seconds, step, hot_rows)
    return found.select(*keys, "window_us", (F.col("increase") / F.lit(float(seconds))).alias("rate"))


def counter_quantile(
    samples: DataFrame, quantiles: dict[str, float], keys: Sequence[str] = (), series: Sequence[str] = (), seconds: int = 60,
    step: int = 60, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Quantiles from cumulative bucket counters with an upper bound ``le`` (double, infinity for the last one).

    The rates of a bucket are summed over all other columns of the series before the quantile is taken, which is interpolated
    inside the bucket that reaches the rank. Without a bucket to infinity, with fewer than two buckets or without any
    increase the quantiles are null; a rank in the last bucket gives the highest finite bound. Counts that fall from
    one bound to the next are raised to the one before.
    """
    rates = counter_rate(samples, [*keys, *series, "le"], seconds, step, hot_rows)
    per_bound = rates.groupBy("window_us", *keys, "le").agg(F.sum("rate").alias("r"))
    buckets = per_bound.groupBy("window_us", *keys).agg(F.sort_array(F.collect_list(F.struct("le", "r"))).alias("b"))  # one row for each bound
    level = F.transform(F.sequence(F.lit(1), F.size("b")), lambda k: F.array_max(F.slice("b.r", F.lit(1), k)))
    buckets = buckets.select("window_us", *keys, F.col("b.le").alias("le"), level.alias("c"))
    size = F.size("le")
    usable = (size >= 2) & (F.element_at("le", -1) == float("inf")) & (F.element_at("c", -1) > 0)

    def at(q: float) -> Column:
        rank = F.lit(q) * F.element_at("c", -1)
        i = F.size(F.filter(F.slice("c", F.lit(1), size - 1), lambda x: x < rank)) + 1  # from 1; size if only the last one reaches it
        end = F.element_at("le", i)
        low = F.when(i > 1, F.element_at("le", F.greatest(i - 1, F.lit(1)))).otherwise(0.0)
        below = F.when(i > 1, F.element_at("c", F.greatest(i - 1, F.lit(1)))).otherwise(0.0)
        inside = low + (end - low) * F.try_divide(rank - below, F.element_at("c", i) - below)
        found = F.when(i == size, F.element_at("le", -2)).when((i == 1) & (end <= 0), end).otherwise(F.coalesce(inside, low))
        return F.when(usable, found)

    return buckets.select("window_us", *keys, *[at(q).alias(name) for name, q in quantiles.items()])
