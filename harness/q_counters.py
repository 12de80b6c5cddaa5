"""Queries on scraped counters: the events give the times of the scrapes, counters grow with time and start again now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators import counters
from harness import views as V
from harness.registry import query
from harness.sql import EVENTS, chain

RANGE, STEP = 36 * 3600, 12 * 3600
# Minutes since the start, faster for some series; back to zero after 20 000, at another time for each series.
VALUE = "(ts_us // 60000000 * (u % 7 + 1) + u % 7 * 1000) % 20000"
BOUNDS = (0.1, 0.5, 1.0, 5.0, float("inf"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(job, ts_us, value): one counter for each job."""
    return V.event_columns(spark, sf).select(
        (F.col("u") % 7).alias("job"), "ts_us", F.expr(VALUE.replace("//", "div")).cast("double").alias("value")
    )


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, job, le, ts_us, value): bucket i of n holds i (i + 1) / (n (n + 1)) of the observations."""
    n = len(BOUNDS)
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.lit((k + 1) * (k + 2)).alias("w")) for k, b in enumerate(BOUNDS)])
    found = V.event_columns(spark, sf).withColumn("kind", F.col("u") % 2).select(
        "kind", (F.col("u") % 7).alias("job"), "ts_us", F.expr(VALUE.replace("//", "div")).alias("v"), F.explode(rows).alias("b")
    )
    return found.select("kind", "job", "ts_us", F.col("b.le").alias("le"), F.expr(f"v * b.w div {n * (n + 1)}").cast("double").alias("value"))


def _increase(keys: str, source: str) -> str:
    """The windows from the definition, each sample put into each of its windows."""
    us, step = RANGE * 1_000_000, STEP * 1_000_000
    return f"""
dl as (select *, case when p is null then 0 when value < p then value else value - p end as d from (
  select *, lag(value) over (partition by {keys} order by ts_us, value) as p from ({source}))),
sw as (select *, unnest(range((ts_us - 1) // {step} + 1, (ts_us - 1) // {step} + 1 + {RANGE // STEP})) * {step} as window_us from dl),
ag as (
  select {keys}, window_us, count(*) as n, min(ts_us) as f, max(ts_us) as l, arg_min(value, (ts_us, value)) as fv,
    sum(d) - arg_min(d, (ts_us, value)) as grown
  from sw group by {keys}, window_us having count(*) >= 2 and max(ts_us) > min(ts_us)),
gp as (select *, (l - f)::double / (n - 1) as gap, f - (window_us - {us}) as to_start, window_us - l as to_end from ag),
st as (
  select *, case when to_start >= gap * 1.1::double then gap / 2 else to_start::double end as s0,
    case when to_end >= gap * 1.1::double then gap / 2 else to_end::double end as e,
    case when grown > 0 and fv >= 0 then (l - f) * (fv / grown) end as z from gp),
inc as (select *, grown * (((l - f) + case when z < s0 then z else s0 end + e) / (l - f)) as increase from st)"""


_ONE = f"select u % 7 as job, ts_us, ({VALUE})::double as value from e"
_MANY = f"""select u % 2 as kind, u % 7 as job, ts_us, le, ({VALUE} * w // {len(BOUNDS) * (len(BOUNDS) + 1)})::double as value
from e, (values {", ".join(f"('{b}'::double, {(k + 1) * (k + 2)})" for k, b in enumerate(BOUNDS))}) b(le, w)"""


@query("counter_increase", chain(EVENTS, _increase("job", _ONE), final="select job, window_us, round(increase, 6) as increase from inc"))
def _counter_increase(spark, sf):
    found = counters.counter_increase(samples(spark, sf), ["job"], RANGE, STEP)
    return found.withColumn("increase", F.round("increase", 6))


@query("counter_rate", chain(EVENTS, _increase("job", _ONE), final=f"select job, window_us, round(increase / {RANGE}.0::double, 9) as rate from inc"))
def _counter_rate(spark, sf):
    """A limit that nearly all series exceed, so that they are cut into pieces."""
    found = counters.counter_rate(samples(spark, sf), ["job"], RANGE, STEP, hot_rows=40)
    return found.withColumn("rate", F.round("rate", 9))


def _at(q: float) -> str:
    return f"""(select round(case when i = size then les[size - 1] else coalesce(lo + (les[i] - lo) * (({q}::double * cs[size] - be) / nullif(cs[i] - be, 0)), lo) end, 6)
  from (select i, case when i > 1 then les[i - 1] else 0 end as lo, case when i > 1 then cs[i - 1] else 0 end as be
    from (select len(list_filter(cs[1:size - 1], lambda x: x < {q}::double * cs[size])) + 1 as i)))"""


@query("counter_quantile", chain(EVENTS, _increase("kind, job, le", _MANY), f"""
bd as (select kind, window_us, le, sum(increase / {RANGE}.0::double) as r from inc group by all),
mx as (select *, max(r) over (partition by kind, window_us order by le rows unbounded preceding) as c from bd),
ls as (select kind, window_us, list(le order by le) as les, list(c order by le) as cs, count(*) as size from mx group by all)""", final=f"""
select kind, window_us, case when size >= 2 and les[size] = 'inf'::double and cs[size] > 0 then {_at(0.5)} end as p50,
  case when size >= 2 and les[size] = 'inf'::double and cs[size] > 0 then {_at(0.95)} end as p95 from ls"""))
def _counter_quantile(spark, sf):
    found = counters.counter_quantile(buckets(spark, sf), {"p50": 0.5, "p95": 0.95}, ["kind"], ["job"], RANGE, STEP)
    return found.select("kind", "window_us", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
