"""Counters, rates, latency histograms and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import count_when, ratio
from flowtide.functions.ordered import Lane, cut, scan
from flowtide.operators.response import sliding_counts
from flowtide.schemas import LATENCY_BOUNDS

SECOND_US = 1_000_000
_DAY_US = 86_400 * SECOND_US


def active_flows(flows: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Open flows at the end of each time bucket in which a flow opened or closed.

    Flows become +1 and -1 events that are summed per bucket first. The running sum goes day by day,
    and one row per day carries the level on.
    """
    width = bucket_seconds * SECOND_US

    def bucket(us: str) -> Column:
        return (F.floor(F.col(us) / width) * width).alias("bucket_us")

    events = F.array(
        F.struct(bucket("start_us"), F.lit(1).alias("opened"), F.lit(0).alias("closed")),
        F.struct(bucket("close_us"), F.lit(0).alias("opened"), F.lit(1).alias("closed")),
    )
    per_bucket = (
        flows.select(F.inline(events))
        .groupBy("bucket_us")
        .agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
        .withColumn("_day", F.floor(F.col("bucket_us") / _DAY_US))
    )
    lane = Lane((), ("bucket_us",), "_day")
    return scan(per_bucket, lane, total={"active": F.col("opened") - F.col("closed")}).drop("_day")


def packets_by_protocol(flows: DataFrame, interface: str = "eth0") -> DataFrame:
    return flows.groupBy(F.lit(interface).alias("interface"), F.col("proto").alias("protocol")).agg(
        F.sum("spkts").alias("packets")
    )


def threats_by_category(alerts: DataFrame) -> DataFrame:
    """Counts by category and severity, with the sum over severities (null severity)."""
    return (
        alerts.groupingSets([["attack_cat", "severity"], ["attack_cat"]], "attack_cat", "severity")
        .agg(F.count(F.lit(1)).alias("threats"))
    )


def mitigations_by_action(events: DataFrame, target: str = "ip") -> DataFrame:
    """Counts by action and the total over all (null action)."""
    return (
        events.withColumn("target", F.lit(target))
        .groupingSets([["action", "target"], []], "action", "target")
        .agg(F.count(F.lit(1)).alias("mitigations"))
    )


def produced_by_topic(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic", "status").agg(F.count(F.lit(1)).alias("messages"))


def _bound_counts(value: Column) -> Column:
    return F.array(*[count_when(value <= F.lit(b)) for b in LATENCY_BOUNDS])


def latency_histogram(samples: DataFrame, value: str = "seconds") -> DataFrame:
    """Cumulative bucket counts with the overall sum and count, in one pass."""
    v = F.col(value)
    one = samples.agg(
        _bound_counts(v).alias("c"),
        # The sum is taken over fixed-point numbers: the same in any order.
        F.sum(v.cast("decimal(20,9)")).cast("double").alias("latency_sum"),
        F.count(v).alias("latency_count"),
    )
    le = F.array(*[F.lit("+Inf" if b == float("inf") else f"{b:.6f}") for b in LATENCY_BOUNDS])
    return one.select(F.inline(F.arrays_zip(le.alias("le"), F.col("c").alias("bucket"))), "latency_sum", "latency_count")


def latency_percentiles(samples: DataFrame, order: list[str], value: str = "seconds", last: int | None = None) -> DataFrame:
    """Mean and percentiles with linear interpolation over all samples, or over the ``last`` ones by ``order``.

    Exact at any size: samples are counted per distinct value, and the running count over values is
    range-partitioned. Without samples all figures are 0.
    """
    recent = samples if last is None else samples.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    per = recent.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed, lane = cut(per, (), ["v"], name="latencies")
    upto = scan(placed, lane, total={"upto": F.col("n")})
    total = placed.agg(F.sum("n").alias("total"), F.sum(F.col("v").cast("decimal(20,9)") * F.col("n")).alias("sum"))
    found = []
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        rank = F.lit(q) * (F.col("total") - 1)
        low, high = (F.min(F.when(F.col("upto") > r, F.col("v"))) for r in (F.floor(rank), F.ceil(rank)))
        found += [low.alias(f"{name}_low"), high.alias(f"{name}_high"), F.max(rank - F.floor(rank)).alias(f"{name}_part")]
    totals = F.broadcast(total.withColumn("_one", F.lit(1)))  # one row
    one = upto.withColumn("_one", F.lit(1)).join(totals, "_one").agg(F.max(F.col("sum").cast("double") / F.col("total")).alias("mean"), *found)
    between = lambda n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")
    return one.select(F.coalesce("mean", F.lit(0.0)).alias("mean"), *[F.coalesce(between(n), F.lit(0.0)).alias(n) for n in ("p50", "p95", "p99")])


def windowed_rate(rows: DataFrame, keys: list[str], seconds: int = 30, slide: int = 5) -> DataFrame:
    """Events per second in overlapping windows."""
    counts = sliding_counts(rows, seconds * SECOND_US, slide * SECOND_US, keys)
    return counts.select("window_us", *keys, (F.col("n") / F.lit(float(seconds))).alias("rate"))


def windowed_increase(rows: DataFrame, keys: list[str], seconds: int = 60) -> DataFrame:
    width = seconds * SECOND_US
    start = (F.floor(F.col("ts_us") / width) * width).alias("window_us")
    return rows.groupBy(start, *keys).agg(F.count(F.lit(1)).alias("increase"))


def bucket_quantile(samples: DataFrame, quantiles: dict[str, float], seconds: int = 60, value: str = "seconds") -> DataFrame:
    """Quantiles per window, interpolated inside histogram buckets.

    A rank in the last, open bucket gives the highest finite bound; a window without values gives null.
    """
    width = seconds * SECOND_US
    start = (F.floor(F.col("ts_us") / width) * width).alias("window_us")
    per = samples.groupBy(start).agg(_bound_counts(F.col(value)).alias("c"))
    bounds = F.array(*[F.lit(b) for b in [0.0, *LATENCY_BOUNDS]])
    n = F.col("c")[len(LATENCY_BOUNDS) - 1]

    def at(q: float) -> Column:
        rank = F.lit(q) * n
        # First bucket whose cumulative count reaches the rank, from 1.
        i = (F.size(F.filter("c", lambda x: x < rank)) + 1).cast("int")
        below = F.when(i > 1, F.element_at("c", F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0))
        low, high = F.element_at(bounds, i), F.element_at(bounds, i + 1)
        inside = low + (high - low) * F.try_divide(rank - below, F.element_at("c", i) - below)
        return F.when(i >= len(LATENCY_BOUNDS), F.lit(LATENCY_BOUNDS[-2])).otherwise(inside)

    return per.select("window_us", *[at(q).alias(name) for name, q in quantiles.items()])


def run_summary(
    flows: DataFrame, alerts: DataFrame, blocks: DataFrame, latency: DataFrame, messages: DataFrame, target_rate: float = 5000.0
) -> DataFrame:
    """One row about a run; each input is reduced to one row before they meet.

    messages: (failed boolean), a row for each message; without any the error rate is 0.
    """
    seen = flows.agg(
        F.count(F.lit(1)).alias("flows"),
        ((F.max("close_us") - F.min("start_us")) / F.lit(1e6)).alias("seconds"),
    )
    flagged = alerts.agg(F.count(F.lit(1)).alias("flagged"))
    active = blocks.agg(F.count(F.lit(1)).alias("active_blocks"))
    sent = messages.agg(ratio(count_when(F.col("failed")), F.count(F.lit(1))).alias("error_rate"))
    parts = [df.withColumn("_one", F.lit(1)) for df in (seen, flagged, active, sent, latency.select("p50", "p95", "p99"))]
    row = parts[0]
    for other in parts[1:]:
        row = row.join(F.broadcast(other), "_one")  # one row each
    rate = F.try_divide(F.col("flows").cast("double"), F.col("seconds"))
    return row.select(
        "flows", "flagged", "active_blocks", "p50", "p95", "p99",
        rate.alias("flows_per_second"), (rate / F.lit(target_rate) * 100).alias("target_share"),
        "error_rate",
    )
