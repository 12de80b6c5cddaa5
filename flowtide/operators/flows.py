"""Packets to bidirectional flows.

``flow_packets`` puts every packet into its flow and adds what depends on packet order;
``flow_measures`` is one aggregate over that. Both run on one exchange of the packets on the flow key,
next to a thin one that finds where the active timeout cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.columns import count_when, iso_utc, lookup, ratio, round_even
from flowtide.functions.ordered import HOT_ROWS, PIECE, SLOT, Lane, cut, in_lanes, scan, split_hot
from flowtide.schemas import (
    ACTIVE_TIMEOUT_S,
    FLAGS,
    FLOW_FEATURES,
    FLOW_IDENTITY,
    FLOW_TIMEOUT_S,
    MIN_DURATION_S,
    SERVICE_PORTS,
)
from flowtide.session import materialise

# The hash comes first: most comparisons of a sort by key are then settled by one number.
KEY = ["key_hash", "ip_a", "port_a", "ip_b", "port_b", "proto"]
ORDER = ("ts_us", "pkt_id")
FLOW = [*KEY, "flow_no"]
_KEY_TYPES = "key_hash long, ip_a string, port_a int, ip_b string, port_b int, proto string"
# State codes: the aggregate keeps numbers, the name is put in at the end.
_STATES = {1: "REQ", 2: "CON", 3: "ACC", 4: "FIN", 5: "RST"}


def flow_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free key (endpoint a sorts before b) and whether the sender is a."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    a_first = (src < dst) | ((src == dst) & (F.col("src_port") <= F.col("dst_port")))
    keyed = packets.withColumns(
        {
            "ip_a": F.when(a_first, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "port_a": F.when(a_first, F.col("src_port")).otherwise(F.col("dst_port")),
            "ip_b": F.when(a_first, F.col("dst_ip")).otherwise(F.col("src_ip")),
            "port_b": F.when(a_first, F.col("dst_port")).otherwise(F.col("src_port")),
            "from_a": a_first,
        }
    )
    return keyed.withColumn("key_hash", F.xxhash64(*KEY[1:]))


def _micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _opens(gap_us: int, extra: Column | None = None) -> Column:
    """A packet opens a flow after silence, after a FIN/RST packet, or as the first of its key."""
    opens = (
        F.col("_prev_ts").isNull()
        | F.col("_prev_end")
        | (F.col("ts_us") - F.col("_prev_ts") >= F.lit(gap_us))
    )
    return opens | F.coalesce(extra, F.lit(False)) if extra is not None else opens


def _islands(thin: DataFrame, lane: Lane, gap_us: int) -> DataFrame:
    """Number the runs of packets that only silence, FIN or RST separates, with the start of each."""
    lagged = scan(thin, lane, before={"_prev_ts": F.col("ts_us"), "_prev_end": F.col("ends")})
    opened = lagged.withColumn("opens", _opens(gap_us))
    return scan(
        opened,
        lane,
        total={"island": F.col("opens").cast("long")},
        upto={"island_us": F.when(F.col("opens"), F.col("ts_us"))},
    ).drop("_prev_end")


def _starts_in_order(active_us: int):
    """Marks for rows that arrive run by run in time order; only the open flow is kept between batches.

    The first row of a run is the one that closes the first flow of it.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, due = 0, False  # start of the open flow; whether the next packet opens a flow
        for batch in batches:
            ts = batch.column("ts_us").to_numpy()
            first = batch.column("first").to_numpy(zero_copy_only=False)
            found: list[int] = []
            for left, right in pairwise([0, *(np.flatnonzero(first[1:]) + 1), len(ts)]):
                at = left
                if len(ts) and first[left]:
                    at, due = left + 1, True
                while at < right:
                    if due:
                        found.append(at)
                        start, due = ts[at], False
                    at += int(np.searchsorted(ts[at:right], start + active_us))
                    due = at < right
                    at += 1
            yield batch.take(pa.array(found, pa.int64())).select([*KEY, *ORDER])

    return marks


def _active_starts(thin: DataFrame, lane: Lane, gap_us: int, active_us: int) -> DataFrame:
    """First packets of the flows that the active timeout opens, for keys of ordinary size.

    Only packets past the first flow of a run reach Python, as Arrow batches in time order. The loop
    makes one step per flow, not per packet, and holds one batch at a time.
    """
    since = F.col("ts_us") - F.col("island_us")
    before = F.col("_prev_ts") - F.col("island_us") < active_us
    late = (
        _islands(thin, lane, gap_us)
        .filter(since >= active_us)
        .select(*KEY, *ORDER, (F.col("opens") | before).alias("first"))
    )
    # Whole keys are in one partition and in order already, so this sort costs nothing.
    ordered = late.sortWithinPartitions(*KEY, *ORDER)
    return ordered.mapInArrow(_starts_in_order(active_us), f"{_KEY_TYPES}, ts_us long, pkt_id long")


def _active_starts_hot(
    thin: DataFrame, pieces: int, gap_us: int, active_us: int
) -> DataFrame:
    """The same for keys too large for one task.

    Every packet points to the packet that would open the next flow if it had opened one itself; the
    starts are what can be reached from the first packet of a run. The number of pointers followed
    doubles in each round, and all joins are on the packet id, so no key gathers in one place.
    """
    placed, lane = cut(thin, KEY, ORDER, pieces, "hot-thin")
    islands = in_lanes(placed, lane, lambda rows, part: _islands(rows, part, gap_us), "hot-thin")
    runs = materialise(islands.drop(PIECE, SLOT, "_prev_ts"), "hot-runs")

    spot = ["at_us", "is_packet", "pkt_id"]
    packets = runs.select(*KEY, "island", F.col("ts_us").alias("at_us"), F.lit(1).alias("is_packet"), "pkt_id")
    deadlines = runs.select(
        *KEY, "island", (F.col("ts_us") + active_us).alias("at_us"), F.lit(0).alias("is_packet"), "pkt_id"
    )
    events, forward = cut(packets.union(deadlines), [*KEY, "island"], spot, 2 * pieces, "hot-deadlines")
    is_packet = F.col("is_packet") == 1

    def seen_ahead(rows: DataFrame, part: Lane) -> DataFrame:
        after = scan(rows, part, before={"_next": F.when(is_packet, F.struct("pkt_id"))})
        return scan(after, part, before={"_cross": F.when(is_packet, F.struct("_next"))})

    crossing = in_lanes(events, forward.reversed(), seen_ahead, "hot-deadlines")
    jumps = materialise(
        crossing.filter(~is_packet & F.col("_cross._next").isNotNull()).select(
            F.col("pkt_id").alias("node"), F.col("_cross._next.pkt_id").alias("to")
        ),
        "hot-jumps",
    )

    frontier = runs.filter("opens").select(F.col("pkt_id").alias("node"))
    reached = frontier.limit(0)
    seen = frontier
    while True:
        new = materialise(
            seen.join(jumps, "node").select(F.col("to").alias("node")), "hot-reached"
        )
        if new.isEmpty():
            break
        reached, seen = reached.union(new), seen.union(new)
        further = jumps.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumps = materialise(jumps.join(further, "to").select("node", F.col("beyond").alias("to")), "hot-jumps")
    return runs.join(reached, runs.pkt_id == reached.node, "left_semi").select(*KEY, *ORDER)


def _in_flows(rows: DataFrame, lane: Lane, gap_us: int) -> DataFrame:
    """Packets and start marks of the lane to packets with flow number and order-dependent columns."""
    here = F.col("is_packet")

    def kept(scanned: DataFrame) -> DataFrame:
        # A scan over pieces reads its rows twice; without this, four scans would run the first one eight times.
        return materialise(scanned, "hot-scanned") if lane.piece else scanned

    lagged = scan(
        rows,
        lane,
        before={
            "_prev_ts": F.when(here, F.col("ts_us")),
            "_prev_end": F.when(here, F.col("fin") | F.col("rst")),
            "_mark": F.when(~here, F.col("pkt_id")),
        },
    ).filter(here)
    opened = kept(lagged).withColumn("opens", _opens(gap_us, F.col("_mark") == F.col("pkt_id")))
    numbered = scan(
        opened,
        lane,
        total={"flow_no": F.col("opens").cast("long"), "pos": F.lit(1).cast("long")},
        upto={"a_opens": F.when(F.col("opens"), F.col("from_a"))},
    ).withColumn("fwd", F.col("from_a") == F.col("a_opens"))

    # A value from an earlier packet counts only if that packet is of the same flow, so its flow number
    # is carried along.
    fwd, flow, ts, gap = F.col("fwd"), F.col("flow_no"), F.col("ts_us"), F.col("gap_us")

    def same_side(name: str) -> Column:
        return F.when(fwd, F.col(f"{name}_f")).otherwise(F.col(f"{name}_b"))

    def by_side(name: str, value: Column, cond: Column) -> dict[str, Column]:
        return {f"{name}_f": F.when(fwd & cond, value), f"{name}_b": F.when(~fwd & cond, value)}

    always = F.lit(True)
    first = scan(
        kept(numbered),
        lane,
        before={
            "_sa": F.when(~fwd & F.col("syn") & F.col("ack"), flow),
            **by_side("_pt", ts, always),
            **by_side("_pn", flow, always),
        },
    )
    gaps = kept(first).withColumns(
        {
            "synack_before": F.coalesce(F.col("_sa") == flow, F.lit(False)),
            "gap_us": F.when(same_side("_pn") == flow, ts - same_side("_pt")),
        }
    ).withColumn("answers", fwd & F.col("ack") & F.col("synack_before"))
    second = scan(
        gaps,
        lane,
        before={
            "_aq": F.when(F.col("answers"), flow),
            **by_side("_gt", gap, gap.isNotNull()),
            **by_side("_gn", flow, gap.isNotNull()),
        },
    )
    first_answer = F.col("answers") & ~F.coalesce(F.col("_aq") == flow, F.lit(False))
    new_state = (
        F.when(F.col("fin"), F.lit(4))
        .when(F.col("rst"), F.lit(5))
        .when(fwd & F.col("syn") & ~F.col("ack"), F.lit(1))
        .when(first_answer, F.lit(2))
        .when(~fwd & F.col("syn") & F.col("ack"), F.lit(3))
    )
    return second.withColumns(
        {
            "jitter_us": F.when(same_side("_gn") == flow, F.abs(gap - same_side("_gt"))),
            "first_answer": first_answer,
            "new_state": new_state,
        }
    ).drop(*[c for c in second.columns if c.startswith("_") and c not in (PIECE, SLOT)], "answers", "is_packet")


def _repeats(rows: DataFrame, hot: bool) -> DataFrame:
    """Mark packets that repeat a positive sequence number of their flow and direction."""
    seq = F.col("tcp_seq")
    if not hot:
        # Packets without a sequence number stand alone, so no group is larger than the flow.
        group = [*FLOW, "fwd", F.when(seq > 0, seq).otherwise(-F.col("pos"))]
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("pos"))
        return rows.withColumn("repeats", (nth > 1).cast("long"))
    # Hot keys: counted by an aggregate with map-side combine, put on the first packet of the flow.
    per_seq = rows.filter(seq > 0).groupBy(*FLOW, "fwd", "tcp_seq").agg((F.count(F.lit(1)) - 1).alias("r"))
    per_flow = per_seq.groupBy(*FLOW).agg(
        F.sum(F.when(F.col("fwd"), F.col("r"))).alias("_rf"),
        F.sum(F.when(~F.col("fwd"), F.col("r"))).alias("_rb"),
    )
    return rows.join(per_flow, FLOW, "left").withColumns(
        {
            "repeats_fwd": F.when(F.col("opens"), F.col("_rf")),
            "repeats_bwd": F.when(F.col("opens"), F.col("_rb")),
        }
    ).drop("_rf", "_rb")


def flow_packets(
    packets: DataFrame,
    flow_timeout: float = FLOW_TIMEOUT_S,
    active_timeout: float = ACTIVE_TIMEOUT_S,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Packets with their flow (``KEY`` + ``flow_no``), direction and order-dependent columns.

    A flow ends before a packet that follows ``flow_timeout`` of silence, on and including a FIN or RST
    packet, and on and including the first packet ``active_timeout`` or more after its start.
    """
    gap_us, active_us = _micros(flow_timeout), _micros(active_timeout)
    keyed = flow_key(packets)
    usual, hot, pieces = split_hot(keyed, KEY, hot_rows)
    lane = Lane(tuple(KEY), (*ORDER, "is_packet"))
    thin = [*KEY, *ORDER, (F.col("fin") | F.col("rst")).alias("ends")]

    def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
        return rows.withColumn("is_packet", F.lit(True)).unionByName(
            marks.withColumn("is_packet", F.lit(False)), allowMissingColumns=True
        )

    by_key = Lane(tuple(KEY), ORDER)
    marked = with_marks(usual, _active_starts(usual.select(*thin), by_key, gap_us, active_us))
    result = _split_repeats(_repeats(_in_flows(marked, lane, gap_us), hot=False))
    if hot is None:
        return result
    marks = _active_starts_hot(hot.select(*thin), pieces, gap_us, active_us)
    rows, hot_lane = cut(with_marks(hot, marks), KEY, lane.order, pieces, "hot-packets")
    in_flows = in_lanes(rows, hot_lane, lambda some, part: _in_flows(some, part, gap_us), "hot-packets").drop(PIECE, SLOT)
    return result.unionByName(_repeats(materialise(in_flows, "hot-flows"), hot=True))


def _split_repeats(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "repeats_fwd": F.when(F.col("fwd"), F.col("repeats")),
            "repeats_bwd": F.when(~F.col("fwd"), F.col("repeats")),
        }
    ).drop("repeats")


def service_of(src_port: Column, dst_port: Column) -> Column:
    return lookup(F.least(src_port, dst_port), SERVICE_PORTS, "-")


def _per_flow(rows: DataFrame) -> DataFrame:
    """All flow measures in one aggregate with numeric buffers."""
    fwd, pos, ts = F.col("fwd"), F.col("pos"), F.col("ts_us")

    def at_last(value: Column, cond: Column) -> Column:
        return F.max_by(value, F.when(cond, pos))

    def first_positive(value: str, cond: Column) -> Column:
        return F.coalesce(F.min_by(F.col(value), F.when(cond & (F.col(value) > 0), pos)), F.lit(0))

    syn, ack = F.col("syn"), F.col("ack")
    sides = {}
    for side, cond in (("s", fwd), ("d", ~fwd)):
        sides |= {
            f"{side}pkts": count_when(cond),
            f"{side}bytes": F.coalesce(F.sum(F.when(cond, F.col("length"))), F.lit(0)),
            f"{side}ttl": F.coalesce(at_last(F.col("ttl"), cond), F.lit(0)).cast("long"),
            f"{side}win": first_positive("tcp_window", cond),
            f"{side}tcpb": first_positive("tcp_seq", cond),
            f"{side}gap_us": F.sum(F.when(cond, F.col("gap_us"))),
            f"{side}gaps": F.count(F.when(cond, F.col("gap_us"))),
            f"{side}jit_us": F.sum(F.when(cond, F.col("jitter_us"))),
            f"{side}jits": F.count(F.when(cond, F.col("jitter_us"))),
        }
    measures = {
        "opener": F.min_by("pkt_id", pos),
        "start_us": F.min(ts),
        "last_us": F.max(ts),
        "ended": F.max_by((F.col("fin") | F.col("rst")).cast("int"), pos),
        **sides,
        "sloss": F.coalesce(F.sum("repeats_fwd"), F.lit(0)),
        "dloss": F.coalesce(F.sum("repeats_bwd"), F.lit(0)),
        "size_sum": F.sum("length"),
        "size_sq": F.sum(F.col("length").cast("decimal(19,0)") * F.col("length").cast("decimal(19,0)")),
        "syn_us": at_last(ts, fwd & syn & ~ack),
        "synack_us": at_last(ts, ~fwd & syn & ack),
        "ack_us": F.min(F.when(F.col("first_answer"), ts)),
        "state_code": F.coalesce(at_last(F.col("new_state"), F.col("new_state").isNotNull()), F.lit(1)),
        **{f"{f}_n": count_when(F.col(f)) for f in FLAGS},
    }
    return rows.groupBy(*FLOW, "a_opens").agg(*[e.alias(n) for n, e in measures.items()])


def close_time(flow_timeout: float, active_timeout: float) -> Column:
    """When a flow was flushed: at the packet that ended it, or after the silence that did."""
    by_packet = (F.col("ended") == 1) | (F.col("last_us") - F.col("start_us") >= _micros(active_timeout))
    return F.when(by_packet, F.col("last_us")).otherwise(F.col("last_us") + _micros(flow_timeout))


def flow_measures(
    packets: DataFrame,
    flow_timeout: float = FLOW_TIMEOUT_S,
    active_timeout: float = ACTIVE_TIMEOUT_S,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per flow: identity, all packet-derived features (rounded as in the record), and the
    unrounded times ``start_us``, ``last_us``, ``close_us``."""
    placed = flow_packets(packets, flow_timeout, active_timeout, hot_rows)
    return measures_of(placed, flow_timeout, active_timeout)


def measures_of(placed: DataFrame, flow_timeout: float, active_timeout: float) -> DataFrame:
    """The same from packets that are in their flows already."""
    agg = _per_flow(placed)
    a = F.col("a_opens")
    ends = {
        "src_ip": F.when(a, F.col("ip_a")).otherwise(F.col("ip_b")),
        "src_port": F.when(a, F.col("port_a")).otherwise(F.col("port_b")),
        "dst_ip": F.when(a, F.col("ip_b")).otherwise(F.col("ip_a")),
        "dst_port": F.when(a, F.col("port_b")).otherwise(F.col("port_a")),
    }
    span = F.col("last_us") - F.col("start_us")
    n = F.col("spkts") + F.col("dpkts")
    dur = F.greatest(F.lit(MIN_DURATION_S), span / F.lit(1e6))

    def ms(us: Column) -> Column:
        return us / F.lit(1e3)

    def wait(later: str, earlier: str) -> Column:
        return F.coalesce(F.greatest(F.lit(0), F.col(later) - F.col(earlier)), F.lit(0))

    whole = n.cast("decimal(19,0)")
    total = F.col("size_sum").cast("decimal(19,0)")
    square = (whole * F.col("size_sq") - total * total).cast("double")
    flags = F.greatest(sum((F.col(f"{f}_n") for f in FLAGS[1:]), F.col(f"{FLAGS[0]}_n")), F.lit(1))
    synack, ackdat = wait("synack_us", "syn_us"), wait("ack_us", "synack_us")
    rounded = {
        "dur": (dur, 6),
        "rate": (n / dur, 4),
        "sload": (F.col("sbytes") * 8.0 / dur, 4),
        "dload": (F.col("dbytes") * 8.0 / dur, 4),
        "sinpkt": (ms(ratio(F.col("sgap_us"), F.col("sgaps"))), 4),
        "dinpkt": (ms(ratio(F.col("dgap_us"), F.col("dgaps"))), 4),
        "sjit": (ms(ratio(F.col("sjit_us"), F.col("sjits"))), 4),
        "djit": (ms(ratio(F.col("djit_us"), F.col("djits"))), 4),
        "tcprtt": (ms(synack + ackdat), 4),
        "synack": (ms(synack), 4),
        "ackdat": (ms(ackdat), 4),
        "smean": (ratio(F.col("sbytes"), F.col("spkts")), 2),
        "dmean": (ratio(F.col("dbytes"), F.col("dpkts")), 2),
        "pkt_size_var": (F.when(n > 1, square / (n * (n - 1)).cast("double")).otherwise(F.lit(0.0)), 2),
        **{f"{f}_ratio": (F.col(f"{f}_n") / flags, 4) for f in ("syn", "ack", "fin", "rst")},
    }
    out = agg.withColumns(ends).withColumns(
        {
            "flow_id": F.format_string(
                "%s:%d->%s:%d_%s", F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("proto")
            ),
            "timestamp": iso_utc(F.col("last_us")),
            "service": service_of(F.col("src_port"), F.col("dst_port")),
            "state": lookup(F.col("state_code"), _STATES, "REQ"),
            "close_us": close_time(flow_timeout, active_timeout),
            **{name: round_even(value, digits) for name, (value, digits) in rounded.items()},
        }
    )
    measured = [f for f in FLOW_FEATURES if not f.startswith("ct_")]
    return out.select(*FLOW_IDENTITY, *measured, "flow_no", "opener", "start_us", "last_us", "close_us")
