import random

import pytest
from pyspark.sql import functions as F

from flowtide.functions.ordered import MANY, PIECE, Lane, cut, hot_keys, in_lanes, number_rows, pieces_for, scan, split_hot
from flowtide.operators import packets as pk


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, "big" if rng.random() < 0.6 else f"k{i % 20}", rng.choice([None, rng.randint(0, 9)])) for i in range(600)]
    return data, spark.createDataFrame(data, "id long, key string, v int")


@pytest.mark.parametrize("descending", [False, True])
def test_scan_over_pieces_equals_plain_fold(spark, rows, descending):
    data, df = rows
    placed, lane = cut(df, ["key"], ["id"], pieces=7)
    lane = lane.reversed() if descending else lane
    got = {
        r["id"]: (r["b"], r["u"], r["t"])
        for r in scan(placed, lane, before={"b": F.col("v")}, upto={"u": F.col("v")}, total={"t": F.lit(1)}).collect()
    }
    last, n = {}, {}
    for i, key, v in sorted(data, reverse=descending):
        before = last.get(key)
        last[key] = before if v is None else v
        n[key] = n.get(key, 0) + 1
        assert got[i] == (before, last[key], n[key])


def test_pieces_split_the_hot_key(spark, rows):
    _, df = rows
    placed, lane = cut(df, ["key"], ["id"], pieces=6)
    assert placed.filter("key = 'big'").select(lane.piece).distinct().count() >= 3


def test_number_rows_is_the_rank(spark, rows):
    data, df = rows
    got = {r["id"]: r["seq"] for r in number_rows(df.repartition(5), ["key", "id"], start=10).collect()}
    for rank, (_, i) in enumerate(sorted((k, i) for i, k, _ in data)):
        assert got[i] == rank + 10


def test_hot_keys_finds_the_big_one(spark, rows):
    _, df = rows
    assert hot_keys(df, ["key"], 1000) == {}
    assert len(hot_keys(df, ["key"], 100)) == 1


def test_plain_lane_needs_no_table(spark, rows):
    _, df = rows
    plan = scan(df, Lane(("key",), ("id",)), before={"b": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_normalise_golden(spark):
    raw = spark.createDataFrame(
        [(1, 4, 6, 1000, 80, "SA", 7, 9), (2, 4, 17, 53, 53, "", 7, 9), (3, 4, 1, 1, 1, "S", 7, 9), (4, None, 6, 1, 2, "S", 1, 1), (5, 4, 47, 1, 2, "F", 1, 1)],
        "pkt_id long, ip_version int, proto_num int, sport int, dport int, flags string, tcp_seq long, tcp_window long",
    )
    got = {r["pkt_id"]: r for r in pk.normalise_packets(raw).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert (got[1]["proto"], got[1]["src_port"], got[1]["syn"], got[1]["ack"], got[1]["fin"]) == ("tcp", 1000, True, True, False)
    assert (got[2]["proto"], got[2]["src_port"], got[2]["tcp_seq"]) == ("udp", 53, 0)
    assert (got[3]["proto"], got[3]["src_port"], got[3]["syn"]) == ("icmp", 0, False)
    assert got[5]["proto"] == "proto-47"


def test_shared_folder_is_the_configured_one_or_local_only():
    from types import SimpleNamespace

    from flowtide.session import shared_folder

    def session(**settings):
        conf = SimpleNamespace(get=lambda name, default=None: settings.get(name.replace(".", "_"), default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app"))

    assert shared_folder(session(spark_checkpoint_dir="hdfs:///c/")) == "hdfs:///c"
    local = session(spark_master="local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(RuntimeError):
        shared_folder(session(spark_master="yarn"))


def test_a_low_limit_cuts_large_tables_into_few_pieces(spark):
    """Many hot keys: the pieces follow the rows, not the limit, and what goes from piece to piece stays small."""
    df = spark.range(20_000).select("id", (F.col("id") % 500).alias("key"), (F.col("id") % 3).alias("v"))
    usual, hot, pieces = split_hot(df.unionByName(spark.range(3).select("id", F.lit(None).cast("long").alias("key"), F.col("id").alias("v"))), ["key"], 10)
    assert pieces == MANY and pieces_for(60_000_000, 10) == 480 and pieces_for(100, 10) == 20
    assert usual.count() == 3 and hot.count() == 20_000
    placed, lane = cut(hot, ["key"], ["id"], pieces)
    got = scan(placed, lane, total={"t": F.lit(1)}, before={"b": F.col("v")})
    assert got.where((F.col("t") - 1 != F.expr("id div 500")) | ~F.col("b").eqNullSafe(F.when(F.col("id") >= 500, (F.col("id") - 500) % 3))).count() == 0


def test_only_keys_of_several_pieces_are_carried(spark):
    """Null and small keys lie within one piece and take the plain scan; both ways together give the plain running sum."""
    rows = [(k, i, 1 + i % 3) for k, n in ((None, 7), (1, 40), (2, 3), (3, 2)) for i in range(n)]
    df = spark.createDataFrame([(k, n, v) for n, (k, _, v) in enumerate(rows)], "k int, n int, v int")
    placed, lane = cut(df, ["k"], ["n"], pieces=4)
    seen = []

    def work(some, part):
        seen.append((part.piece, {r.k for r in some.select("k").distinct().collect()}))
        return scan(some, part, total={"s": F.col("v")}).select("k", "n", "s")

    got = {r.n: r.s for r in in_lanes(placed, lane, work, "rows").collect()}
    want, sums = {}, {}
    for n, (k, _, v) in enumerate(rows):
        sums[k] = want[n] = sums.get(k, 0) + v
    assert got == want
    (plain, within), (pieced, across) = seen
    spanning = {r.k for r in placed.groupBy("k").agg(F.count_distinct(PIECE).alias("p")).where("p > 1").collect()}
    assert (plain, pieced) == (None, PIECE)
    assert 1 in spanning <= across and not within & across and within | across == {None, 1, 2, 3} and within
