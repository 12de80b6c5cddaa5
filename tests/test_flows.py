import random

import pytest
from flow_fold import fold
from pyspark.sql import functions as F

from flowtide.operators import flows
from flowtide.operators.context import context_counts, recent_counts
from flowtide.plans.flow_records import flow_records
from flowtide.schemas import FLOW_FEATURES, FLOW_IDENTITY, PACKET
from harness import views as V

FLOATS = ["dur", "rate", "sload", "dload", "sinpkt", "dinpkt", "sjit", "djit", "tcprtt", "synack", "ackdat", "smean",
          "dmean", "pkt_size_var", "syn_ratio", "ack_ratio", "fin_ratio", "rst_ratio"]
EXACT = ["state", "spkts", "dpkts", "sbytes", "dbytes", "sttl", "dttl", "swin", "dwin", "stcpb", "dtcpb", "sloss", "dloss",
         "close_us"]
KEY = ["src_ip", "src_port", "dst_ip", "dst_port", "proto", "start_us", "last_us"]


def packet(pkt_id, ts, src, dst, length=60, ttl=64, flags="", seq=0, window=0, proto="tcp"):
    flag = [letter in flags for letter in "SAFRPU"]
    return (pkt_id, ts, src[0], dst[0], src[1], dst[1], proto, length, ttl, *flag, seq, window)


def agree(spark, packets, timeouts, hot_rows):
    rows = [r.asDict() for r in packets.collect()]
    want = {tuple(f[c] for c in KEY): f for f in fold(rows, *(int(t * 1e6) for t in timeouts))}
    got = [r.asDict() for r in flows.flow_measures(packets, *timeouts, hot_rows=hot_rows).collect()]
    assert len(got) == len(want)
    for g in got:
        w = want[tuple(g[c] for c in KEY)]
        for c in EXACT:
            assert g[c] == w[c], (c, g, w)
        for c in FLOATS:
            assert g[c] == pytest.approx(w[c], abs=0.0051, rel=1e-9), (c, g, w)


def test_handshake_golden(spark):
    a, b = ("192.168.1.10", 54321), ("10.0.0.1", 443)
    rows = [
        packet(1, 100_000_000, a, b, flags="S", seq=1000, window=29200),
        packet(2, 100_020_000, b, a, flags="SA", seq=2000, window=29200),
        packet(3, 100_040_000, a, b, length=1500, flags="A", seq=1001, window=29200),
    ]
    got = flow_records(spark.createDataFrame(rows, PACKET)).collect()
    assert len(got) == 1
    want = dict(
        spkts=2, dpkts=1, sbytes=1560, dbytes=60, tcprtt=40.0, service="ssl", dur=0.04, rate=75.0, synack=20.0, ackdat=20.0,
        sinpkt=40.0, dinpkt=0.0, sjit=0.0, djit=0.0, state="CON", sloss=0, dloss=0, swin=29200, dwin=29200, stcpb=1000,
        dtcpb=2000, smean=780.0, dmean=60.0, pkt_size_var=691200.0, syn_ratio=0.5, ack_ratio=0.5, ct_dst_ltm=1,
        flow_id="192.168.1.10:54321->10.0.0.1:443_tcp", timestamp="1970-01-01T00:01:40.040000+00:00",
    )
    assert {k: got[0][k] for k in want} == want


@pytest.mark.parametrize("hot_rows", [10**6, 40])
@pytest.mark.parametrize("timeouts", [V.P1, V.P2])
def test_flows_match_fold(spark, sf, timeouts, hot_rows):
    agree(spark, V.packets(spark, sf), timeouts, hot_rows)


@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_random_packets_match_fold(spark, hot_rows):
    """Few keys, dense times, ties, every flag, defaults of the timeouts; one key holds half the rows."""
    rng = random.Random(7)
    ends = [(f"10.0.0.{i}", 1000 + i) for i in range(4)]
    rows, ts = [], 0
    for i in range(300):
        ts += rng.choice([0, 500_000, 4_000_000, 16_000_000])
        a, b = (ends[0], ends[1]) if rng.random() < 0.5 else rng.sample(ends, 2)
        if rng.random() < 0.5:
            a, b = b, a
        flags = "".join(f for f, p in zip("SAFRPU", (0.3, 0.5, 0.05, 0.03, 0.2, 0.05)) if rng.random() < p)
        rows.append(packet(i, ts, a, b, rng.randint(40, 1500), rng.choice([60, 64]), flags, rng.randint(0, 5), rng.choice([0, 1024])))
    packets = spark.createDataFrame(rows, PACKET)
    agree(spark, packets, (15.0, 60.0), hot_rows)


def test_sender_after_fin_opens_the_next_flow(spark):
    a, b = ("10.0.0.9", 5), ("10.0.0.2", 80)
    rows = [packet(1, 0, a, b, flags="S"), packet(2, 1000, b, a, flags="FA"), packet(3, 2000, b, a, flags="A")]
    got = flows.flow_measures(spark.createDataFrame(rows, PACKET)).orderBy("start_us").collect()
    assert [(r["src_ip"], r["spkts"], r["dpkts"], r["state"]) for r in got] == [("10.0.0.9", 1, 1, "FIN"), ("10.0.0.2", 1, 0, "REQ")]


@pytest.mark.parametrize("parts", [1, 50])
def test_result_does_not_depend_on_partitioning(spark, sf, parts):
    cols = [*FLOW_IDENTITY, *FLOW_FEATURES, "seq"]
    base = flow_records(V.packets(spark, sf), *V.P2).select(*cols)
    other = flow_records(V.packets(spark, sf).repartition(parts), *V.P2).select(*cols)
    assert sorted(map(tuple, base.collect())) == sorted(map(tuple, other.collect()))


def test_context_counts_match_brute_force_over_block_borders(spark, sf):
    measured = flows.flow_measures(V.packets(spark, sf), *V.P1)
    got = sorted(context_counts(measured, block=130).collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in got] == list(range(len(got)))
    keys = {"ct_srv_src": ("src_ip", "service"), "ct_state_ttl": ("state", "sttl"), "ct_dst_ltm": ("dst_ip",),
            "ct_src_dport_ltm": ("src_ip", "dst_port"), "ct_dst_sport_ltm": ("dst_ip", "src_port"), "ct_dst_src_ltm": ("src_ip", "dst_ip")}
    for i, row in enumerate(got):
        past = got[max(0, i - 100):i]
        for name, cols in keys.items():
            assert row[name] == 1 + sum(all(p[c] == row[c] for c in cols) for p in past)


def test_flow_plan_has_two_exchanges_and_no_whole_table_window(spark, sf):
    plan = flows.flow_measures(V.packets(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in plan


def test_context_is_dealt_to_tasks_by_rows(spark):
    """Files of a shuffle compress well: by their size all these rows would be sorted in one task or a few."""
    rows = spark.range(40_000).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("k"))
    counted = recent_counts(rows, {"n": ["k"]}, history=30, block=100)
    assert counted.rdd.getNumPartitions() == 100
    assert counted.where((F.col("n") != 11) & (F.col("seq") >= 30)).count() == 0
