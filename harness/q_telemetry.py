"""Telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.operators import response as rs
from flowtide.operators import telemetry as tm
from flowtide.schemas import LATENCY_BOUNDS
from flowtide.operators.alerts import threat_alerts
from flowtide.session import materialise
from harness import views as V
from harness.q_alerts import AT, _LAST
from harness.registry import query
from harness.sql import BLOCKS, LATENCY, EVENTS, PACKETS, chain, on_flows, on_scores

_TOPICS = "case when event_type = 'error' then 'failed' else 'success' end"
_BOUNDS = [b for b in LATENCY_BOUNDS if b != float("inf")]


@query("packets_by_proto", on_flows("select 'eth0' as interface, proto as protocol, sum(spkts) as packets from fl group by proto"))
def _packets(spark, sf):
    from harness.q_flows import measures

    return tm.packets_by_protocol(measures(spark, sf))


@query("threats_by_category", on_scores("""
select attack_cat, severity, count(*) as threats from al group by grouping sets ((attack_cat, severity), (attack_cat))"""))
def _threats(spark, sf):
    return tm.threats_by_category(V.alerts(spark, sf))


@query("mitigations_by_action", chain(EVENTS, BLOCKS, final="""
select event as action, case when event is not null then 'ip' end as target, count(*) as mitigations from be group by grouping sets ((event), ())"""))
def _mitigations(spark, sf):
    return tm.mitigations_by_action(V.block_events(spark, sf).withColumnRenamed("event", "action"))


@query("produced_by_topic", f"select 'network-telemetry' as topic, {_TOPICS} as status, count(*) as messages from events group by all")
def _produced(spark, sf):
    rows = V.table(spark, sf, "events").select(F.lit("network-telemetry").alias("topic"), F.expr(_TOPICS).alias("status"))
    return tm.produced_by_topic(rows)


def _le() -> str:
    rows = [f"select '{b:.6f}' as le, {b!r}::double as b" for b in _BOUNDS] + ["select '+Inf', 'inf'::double"]
    return "bd as (" + " union all ".join(rows) + ")"


@query("latency_histogram", chain(EVENTS, LATENCY, _le(), final="""
select le, count(*) filter (seconds <= b) as bucket, sum(seconds::decimal(20,9))::double as latency_sum, count(*) as latency_count
from lt, bd group by le"""))
def _histogram(spark, sf):
    return tm.latency_histogram(V.latencies(spark, sf))


_PCT = ", ".join(f"round(quantile_cont(seconds, {q}), 9) as {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))


@query("latency_percentiles", chain(EVENTS, LATENCY, final=f"""
select round(avg(seconds::decimal(20,9)), 9) as mean, {_PCT} from lt"""))
def _percentiles(spark, sf):
    one = tm.latency_percentiles(V.latencies(spark, sf), ["ts_us", "event_id"])
    return one.select(*[F.round(c, 9).alias(c) for c in one.columns])


@query("windowed_rate", chain(EVENTS, final="""
select w * 5000000 as window_us, event_type, sum(n) / 30.0::double as rate from (
  select unnest(range(ts_us // 5000000 - 5, ts_us // 5000000 + 1)) as w, event_type, 1 as n from e) group by w, event_type"""))
def _rate(spark, sf):
    return tm.windowed_rate(V.event_columns(spark, sf), ["event_type"])


@query("windowed_increase", chain(EVENTS, final="select ts_us // 60000000 * 60000000 as window_us, event_type, count(*) as increase from e group by all"))
def _increase(spark, sf):
    return tm.windowed_increase(V.event_columns(spark, sf), ["event_type"])


def _quantile(q: float) -> str:
    """Interpolated inside the bucket that reaches the rank."""
    cases, low, below = [], "0.0::double", "0"
    for i, b in enumerate(_BOUNDS):
        cases.append(
            f"when c{i} >= {q}::double * n then {low} + ({b!r}::double - {low}) * (({q}::double * n - {below}) / (c{i} - {below}))"
        )
        low, below = f"{b!r}::double", f"c{i}"
    return f"case {' '.join(cases)} else {_BOUNDS[-1]!r}::double end"


@query("bucket_quantile", chain(EVENTS, LATENCY, final=f"""
select window_us, round({_quantile(0.5)}, 9) as p50, round({_quantile(0.95)}, 9) as p95, round({_quantile(0.99)}, 9) as p99 from (
  select ts_us // 3600000000 * 3600000000 as window_us, count(*) as n,
    {", ".join(f"count(*) filter (seconds <= {b!r}::double) as c{i}" for i, b in enumerate(_BOUNDS))} from lt group by 1)"""))
def _bucket_quantile(spark, sf):
    q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = tm.bucket_quantile(V.latencies(spark, sf), q, seconds=3600)
    return out.select("window_us", *[F.round(c, 9).alias(c) for c in q])


@query("run_summary", on_scores(f"""
select f.*, b.active_blocks, l.*, round(f.flows / s.seconds, 9) as flows_per_second, round(f.flows / s.seconds / 5000.0::double * 100, 9) as target_share,
  (select round(count(*) filter (event_type = 'error')::double / count(*), 9) from e) as error_rate
from (select count(*) as flows, count(*) filter (anomaly_prob >= 0.85::double) as flagged from sc) f,
  (select (max(close_us) - min(start_us)) / 1e6 as seconds from fl) s,
  (select count(*) as active_blocks from lb where event = 'block' and created_us + ttl_seconds * 1000000 > {AT}) b,
  (select {_PCT} from lt) l""", (BLOCKS, _LAST, LATENCY)))
def _summary(spark, sf):
    flows = materialise(V.records(spark, sf), "records")  # read twice
    messages = V.table(spark, sf, "events").select((F.expr(_TOPICS) == "failed").alias("failed"))
    one = tm.run_summary(
        flows, threat_alerts(flows, V.model()), rs.blocks_at(V.block_events(spark, sf), AT),
        tm.latency_percentiles(V.latencies(spark, sf), ["ts_us", "event_id"]), messages,
    )
    exact = ["flows", "flagged", "active_blocks"]
    return one.select(*exact, *[F.round(c, 9).alias(c) for c in one.columns if c not in exact])
