"""Scraped counters against a plain fold, and stored sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowtide.operators import counters, sketches

S = 1_000_000


def plain(samples, end, seconds):
    """Increase of one series over (end - seconds, end], from the definition."""
    inside = [(t, v) for t, v in samples if end - seconds < t <= end]
    if len(inside) < 2 or inside[0][0] == inside[-1][0]:
        return None
    grown = inside[-1][1] - inside[0][1]
    for (_, a), (_, b) in zip(inside, inside[1:]):
        grown += a if b < a else 0
    sampled = inside[-1][0] - inside[0][0]
    gap = sampled / (len(inside) - 1)
    start, stop = inside[0][0] - (end - seconds), end - inside[-1][0]
    start = gap / 2 if start >= gap * 1.1 else start
    if grown > 0 and inside[0][1] >= 0:
        start = min(start, sampled * inside[0][1] / grown)
    stop = gap / 2 if stop >= gap * 1.1 else stop
    return grown * (sampled + start + stop) / sampled


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_increase(spark, hot_rows):
    rnd = random.Random(hot_rows)
    series = {}
    for key in range(4):
        t, v, rows = rnd.randrange(20), rnd.randrange(50), []
        for _ in range(60):
            rows.append((t, float(v)))
            t += rnd.choice([5, 10, 10, 15, 70])
            v = 0 if rnd.random() < 0.1 else v + rnd.randrange(9)
        series[key] = rows
    frame = spark.createDataFrame(
        [(k, t * S, v, "x") for k, rows in series.items() for t, v in rows] + [(0, None, 1.0, ""), (0, 5, None, ""), (0, 7 * S, float("nan"), "")],
        "key long, ts_us long, value double, n string",
    )
    got = {(r["key"], r["window_us"] // S): r["increase"] for r in counters.counter_increase(frame, ["key"], 60, 20, hot_rows).collect()}
    want = {(k, e): plain(rows, e, 60) for k, rows in series.items() for e in range(0, 4000, 20)}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    with pytest.raises(ValueError):
        counters.counter_rate(frame, ["key"], 30, 7)


def test_a_start_at_zero_is_no_fall(spark):
    rows = [(t * S, float(v)) for t, v in ((10, 100), (20, 110), (30, 4), (40, 9))]
    one = counters.counter_rate(spark.createDataFrame(rows, "ts_us long, value double"), [], 40, 40).collect()
    assert [(r["window_us"] // S, round(r["rate"] * 40, 6)) for r in one] == [(40, round(19 * (30 + 10) / 30, 6))]


INF = float("inf")


@pytest.mark.parametrize(
    ("counts", "want"),
    [
        ({0.1: 10, 0.5: 20, INF: 20}, 0.1), ({0.1: 0, 0.5: 20, INF: 20}, 0.3), ({0.1: 2, INF: 20}, 0.1), ({0.1: 5, 0.5: 10}, None),
        ({INF: 5}, None), ({0.1: 0, INF: 0}, None), ({-1.0: 20, 2.0: 20, INF: 20}, -1.0), ({0.1: 12, 0.5: 8, INF: 20}, 0.1 * 10 / 12),
    ],
)
def test_quantile(spark, counts, want):
    rows = [(le, t * S, c * t / 60.0) for le, c in counts.items() for t in (60, 120)]
    frame = spark.createDataFrame(rows, "le double, ts_us long, value double")
    got = counters.counter_quantile(frame, {"p": 0.5}, seconds=120, step=120).collect()
    assert len(got) == 1 and (got[0]["p"] is None if want is None else math.isclose(got[0]["p"], want, rel_tol=1e-9))


def test_sketches_merge(spark):
    n = 40_000
    frame = spark.range(n).select((F.col("id") * 3 * S).alias("ts_us"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 10).alias("seconds"))
    frame = frame.union(spark.createDataFrame([(5, None), (6, float("nan"))], "ts_us long, seconds double"))
    asked = {"p0": 0.0, "p25": 0.25, "p99": 0.99, "p100": 1.0}
    hours = sketches.quantile_sketches(frame)
    days = sketches.merged_sketches(hours)
    assert hours.count() == 34 and days.count() == 2
    answers = sketches.sketch_quantiles(days, asked)
    assert {r["n"] for r in answers.collect()} == {28_800, 11_200}
    checked = sketches.rank_checks(answers, frame, asked).collect()
    assert len(checked) == 8 and all(r["within"] for r in checked)
    wrong = answers.withColumn("p25", F.col("p25") + 200)
    assert sum(not r["within"] for r in sketches.rank_checks(wrong, frame, asked).collect()) == 2


def test_sets_of_two_sides(spark):
    rows = [("a", "x", "1"), ("a", "y", None), ("b", "y", None), ("b", "z", None), ("b", "w", None)]
    stored = sketches.set_sketches(spark.createDataFrame(rows, "side string, c string, d string"), "side", ["c", "d"])
    got = {tuple(r) for r in sketches.unseen_counts(stored, "side", "a", "b").collect()}
    assert got == {("c", "a", 1), ("c", "b", 2), ("d", "a", 1), ("d", "b", 0)}
    alone = sketches.unseen_counts(stored.where("side = 'a'"), "side", "a", "b").collect()
    assert {tuple(r) for r in alone} == {("c", "a", 2), ("c", "b", 0), ("d", "a", 1), ("d", "b", 0)}
