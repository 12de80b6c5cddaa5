"""Queries on stored sketches."""

from __future__ import annotations

from flowtide.operators import sketches as sk
from flowtide.operators.profiling import both_splits
from flowtide.session import materialise
from harness import views as V
from harness.q_labelled import _LONG, _TEXTS, both
from harness.registry import query
from harness.sql import EVENTS, LATENCY, chain, on_labelled

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
_DAY = 86_400_000_000


@query("latency_sketch_ranks", chain(EVENTS, LATENCY, final=f"""
select ts_us // {_DAY} * {_DAY} as from_us, unnest([{", ".join(f"{q}::double" for q in QUANTILES.values())}]) as q, count(*) as n, true as within
from lt where seconds is not null group by 1"""))
def _ranks(spark, sf):
    """Sketches of hours are stored, merged into days, and asked; the true rank of every answer is counted in the samples."""
    samples = V.latencies(spark, sf)
    hours = materialise(sk.quantile_sketches(samples), "hour-sketches")
    answers = sk.sketch_quantiles(sk.merged_sketches(hours), QUANTILES)
    return sk.rank_checks(answers, samples, QUANTILES)


@query("latency_sketch_bounds", chain(EVENTS, LATENCY, final=f"""
select ts_us // {_DAY} * {_DAY} as from_us, count(*) as n, min(seconds) as low, max(seconds) as high from lt where seconds is not null group by 1"""))
def _bounds(spark, sf):
    hours = materialise(sk.quantile_sketches(V.latencies(spark, sf)), "hour-sketches")
    return sk.sketch_quantiles(sk.merged_sketches(hours), {"low": 0.0, "high": 1.0})


@query("unseen_category_counts", on_labelled("""
select "column", only_in, count(distinct value) filter (split = only_in and value not in (
  select value from vl o where o."column" = vl."column" and o.split <> only_in and value is not null)) as n_values
from vl, (values ('train'), ('test')) s(only_in) where value is not null group by "column", only_in""", (_LONG,)))
def _unseen(spark, sf):
    """Set sketches of both splits are stored; their differences are exact below the size of a sketch."""
    stored = materialise(sk.set_sketches(both_splits(*both(spark, sf)), "split", _TEXTS), "set-sketches")
    return sk.unseen_counts(stored, "split", "train", "test")
