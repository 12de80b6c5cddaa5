"""Packet, flow and context queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtide.operators import context, flows, packets
from flowtide.operators.telemetry import active_flows
from flowtide.plans.flow_records import flow_records
from flowtide.schemas import FLAGS, FLOW_FEATURES, FLOW_IDENTITY
from harness import views as V
from harness.registry import query
from harness.sql import CONTEXT_EXT, CLIENT, on_blocks, on_flows, on_packets, on_records, on_segments, EVENTS, PACKETS, BLOCKS, chain

RECORD = [*FLOW_IDENTITY, *FLOW_FEATURES]
ID = ["flow_id", "start_us"]


def quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


def measures(spark, sf, p=V.P1):
    return flows.flow_measures(V.packets(spark, sf), *p)


def headers(spark, sf):
    """Decoded header columns: some rows are not IP, protocols vary, flags are letters."""
    kind = F.col("event_type")
    return V.event_columns(spark, sf).select(
        F.col("event_id").alias("pkt_id"), "ts_us",
        F.when(F.col("event_id") % 11 != 0, 4).alias("ip_version"),
        F.element_at(F.array(F.lit(6), F.lit(17), F.lit(1), F.lit(47)), (F.col("event_id") % 4 + 1).cast("int")).alias("proto_num"),
        (20000 + F.col("u")).cast("int").alias("sport"), F.lit(443).alias("dport"),
        F.when(kind == "signup", "S").when(kind == "purchase", "SA").when(kind == "click", "PA")
        .when(kind == "error", "R").otherwise("FA").alias("flags"),
        (1000 + F.col("k")).alias("tcp_seq"), (1024 * (F.col("k") % 4)).alias("tcp_window"),
    )


@query("packet_normalise", chain(EVENTS, final=f"""
select event_id as pkt_id, ts_us, proto, case when proto in ('tcp', 'udp') then 20000 + u else 0 end as src_port,
  case when proto in ('tcp', 'udp') then 443 else 0 end as dst_port,
  case when proto = 'tcp' then 1000 + k else 0 end as tcp_seq, case when proto = 'tcp' then 1024 * (k % 4) else 0 end as tcp_window,
  {", ".join(f"proto = 'tcp' and contains(flags, '{f[0].upper()}') as {f}" for f in FLAGS)}
from (select *, case event_id % 4 when 0 then 'tcp' when 1 then 'udp' when 2 then 'icmp' else 'proto-47' end as proto,
  case event_type when 'signup' then 'S' when 'purchase' then 'SA' when 'click' then 'PA' when 'error' then 'R' else 'FA' end as flags
  from e where event_id % 11 <> 0)"""))
def _normalise(spark, sf):
    return packets.normalise_packets(headers(spark, sf))


@query("flow_key", on_packets("""
select pkt_id, case when a then src_ip else dst_ip end as ip_a, case when a then src_port else dst_port end as port_a,
  case when a then dst_ip else src_ip end as ip_b, case when a then dst_port else src_port end as port_b, a as from_a, proto
from (select *, (src_ip, src_port) <= (dst_ip, dst_port) as a from pk)"""))
def _key(spark, sf):
    return flows.flow_key(V.packets(spark, sf)).select("pkt_id", *flows.KEY[1:], "from_a")


_SEGMENT = "select pkt_id, f_ip as opener_ip, f_port as opener_port, flow_no, pos as place, fwd from seg"


def _segment(p):
    def run(spark, sf):
        placed = flows.flow_packets(V.packets(spark, sf), *p)
        a = F.col("a_opens")
        w = F.min("pos").over(Window.partitionBy(*flows.FLOW))
        return placed.select(
            "pkt_id", F.when(a, F.col("ip_a")).otherwise(F.col("ip_b")).alias("opener_ip"),
            F.when(a, F.col("port_a")).otherwise(F.col("port_b")).alias("opener_port"),
            "flow_no", (F.col("pos") - w + 1).alias("place"), "fwd",
        )

    return run


query("flow_segment", on_segments(_SEGMENT))(_segment(V.P1))
query("flow_segment_active", on_segments(_SEGMENT, V.P2))(_segment(V.P2))


def _columns(name: str, columns: list[str], p=V.P1):
    query(name, on_flows(f"select {quoted([*ID, *columns])} from fl", p))(
        lambda spark, sf: measures(spark, sf, p).select(*ID, *columns)
    )


_columns("flow_volume", ["spkts", "dpkts", "sbytes", "dbytes", "last_us", "dur"])
_columns("flow_first_last", ["sttl", "dttl", "swin", "dwin", "stcpb", "dtcpb"])
_columns("flow_rates", ["rate", "sload", "dload"])
_columns("flow_size_stats", ["smean", "dmean", "pkt_size_var"])
_columns("flow_interarrival", ["sinpkt", "dinpkt"])
_columns("flow_jitter", ["sjit", "djit"])
_columns("flow_loss", ["sloss", "dloss"])
_columns("tcp_handshake", ["synack", "ackdat", "tcprtt"], V.P2)
_columns("flag_ratios", ["syn_ratio", "ack_ratio", "fin_ratio", "rst_ratio"])
_columns("flow_state", ["state"], V.P2)
_columns("service_map", ["service", "src_port", "dst_port"])
_columns("flow_identity", ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto"])


@query("context_counts", on_records(f"select seq, {quoted(ID)}, {quoted(FLOW_FEATURES[-6:])} from rec"))
def _context(spark, sf):
    return context.context_counts(measures(spark, sf)).select("seq", *ID, *FLOW_FEATURES[-6:])


_EXT = ["ct_src_ltm", "ct_srv_dst", "is_sm_ips_ports"]


@query("context_counts_ext", on_flows(f"select seq, {quoted(ID)}, {quoted(_EXT)} from rec", more=(CONTEXT_EXT,)))
def _context_ext(spark, sf):
    return context.context_counts_ext(measures(spark, sf)).select("seq", *ID, *_EXT)


@query("uni_flow_counters", on_packets("""
select src_ip, dst_ip, src_port, dst_port, proto, count(*) as packets, sum(length) as bytes, min(ts_us) as first_seen_us,
  max(ts_us) as last_seen_us, count(*) filter (proto = 'tcp' and syn) as syn_count, count(*) filter (proto = 'tcp' and ack) as ack_count,
  count(*) filter (proto = 'tcp' and fin) as fin_count, count(*) filter (proto = 'tcp' and rst) as rst_count
from (select * replace (case when proto in ('tcp', 'udp') then src_port else 0 end as src_port,
  case when proto in ('tcp', 'udp') then dst_port else 0 end as dst_port) from pk) group by all"""))
def _counters(spark, sf):
    return packets.one_way_counters(V.packets(spark, sf))


@query("blocklist_filter", chain(EVENTS, PACKETS, BLOCKS, final="""
select pkt_id, src_ip, length from pk where src_ip not in (select target_ip from be where ttl_seconds > 5800)"""))
def _blocklist(spark, sf):
    blocked = V.block_events(spark, sf).filter("ttl_seconds > 5800")
    return packets.drop_blocked(V.packets(spark, sf), blocked).select("pkt_id", "src_ip", "length")


@query("active_flows", on_flows("""
select b as bucket_us, sum(o) as opened, sum(c) as closed, sum(sum(o) - sum(c)) over (order by b) as active
from (select start_us // 3600000000 * 3600000000 as b, 1 as o, 0 as c from fl
  union all select close_us // 3600000000 * 3600000000, 0, 1 from fl) group by b"""))
def _active(spark, sf):
    return active_flows(measures(spark, sf), 3600)


@query("flow_features", on_records(f"select {quoted(RECORD)}, seq from rec"))
def _features(spark, sf):
    return flow_records(V.packets(spark, sf), *V.P1).select(*RECORD, "seq")


@query("flow_features_active", on_records(f"select {quoted(RECORD)}, seq from rec", p=V.P2))
def _features_active(spark, sf):
    return flow_records(V.packets(spark, sf), *V.P2).select(*RECORD, "seq")


@query("flow_features_hot", on_records(f"select {quoted(RECORD)}, seq from rec", p=V.P2))
def _features_hot(spark, sf):
    """The same by the route of keys that are too large for one task, which nearly all keys take at this limit."""
    return flow_records(V.packets(spark, sf), *V.P2, hot_rows=50).select(*RECORD, "seq")
