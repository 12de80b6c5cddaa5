"""Keyed state: arrival out of order, repeated batches, and state that goes away."""

import pytest
from pyspark.sql import functions as F

from flowtide.plans.flow_records import flow_records
from flowtide.schemas import FLOW_FEATURES, FLOW_IDENTITY, PACKET
from flowtide.streaming.keyed import FlowStream, closed_flow_packets, expired_blocks, rocksdb
from harness import views as V

RECORD = [*FLOW_IDENTITY, *FLOW_FEATURES, "seq"]


def files(spark, rows, schema, path, batches):
    for batch in batches:
        spark.createDataFrame([rows[k] for k in batch], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(query, tmp_path, spark):
    with rocksdb(spark):
        out = (
            query.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
    out.awaitTermination()
    return out, spark.read.schema(query.schema).parquet(str(tmp_path / "out")).collect()


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


S = 1_000_000


def packet(k, second, fin=False, src="10.0.0.1"):
    back = k % 2 == 1
    ends = ("10.0.0.9", src, 80, 999) if back else (src, "10.0.0.9", 999, 80)
    return (k, int(second * S), ends[0], ends[1], ends[2], ends[3], "tcp", 60, 64, False, True, fin, False, False, False, k, 10)


def test_packets_leave_when_their_flow_is_over(spark, tmp_path, few_partitions):
    rows = [packet(0, 10), packet(1, 11), packet(2, 12, fin=True), packet(3, 13), packet(4, 60), packet(5, 61), packet(6, 200, src="10.0.0.2"),
            packet(7, 1000, src="10.0.0.3")]
    # Packet 1 comes after packet 3; the flow of 4 and 5 stays open until its silence is over.
    stream = files(spark, rows, PACKET, str(tmp_path / "in"), [[0, 2, 3], [1, 4], [5, 6], [7]])
    query, out = run(closed_flow_packets(stream, "20 seconds", 30.0, 120.0), tmp_path, spark)
    assert sorted(r.pkt_id for r in out) == list(range(7))
    # Only the last packet's key is left.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_flow_stream_equals_batch_and_repeats_change_nothing(spark, sf, tmp_path, few_partitions):
    packets = V.packets(spark, sf)
    path = str(tmp_path / "in")
    middle = packets.approxQuantile("ts_us", [0.5], 0.0)[0]
    for part in (packets.where(F.col("ts_us") < middle), packets.where(F.col("ts_us") >= middle),
                 packets.limit(1).withColumns({"ts_us": F.lit(4 * 10**15), "src_ip": F.lit("z")})):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(path)
    flows = FlowStream(spark, str(tmp_path / "flows"), "1 second", *V.P1)
    flows.start(stream).awaitTermination()
    want = flow_records(packets, *V.P1).select(*RECORD)
    got = sorted(map(tuple, flows.records().select(*RECORD).collect()))
    assert got == sorted(map(tuple, want.collect()))
    last = max(r.batch for r in spark.read.parquet(f"{flows.path}/records").select("batch").distinct().collect())
    assert last > 0
    nothing = spark.createDataFrame([], PACKET)
    flows.advance(nothing, last + 10)
    assert sorted(map(tuple, flows.records().select(*RECORD).collect())) == got


EVENT = "version long, created_us long, target_ip string, event string, ttl_seconds long"


def test_blocks_run_out_once(spark, tmp_path, few_partitions):
    rows = [
        (1, 10 * S, "a", "block", 30), (2, 20 * S, "a", "block", 30),  # replaced, then out at 50
        (3, 15 * S, "b", "block", 100), (4, 60 * S, "b", "unblock", None),  # lifted by an event that comes late
        (5, 70 * S, "c", "block", 5), (6, 72 * S, "c", "block", 5),  # 5 arrives after 6 and is replaced
        (7, 90 * S, "d", "block", None), (8, 95 * S, "d", "block", 1000),
        (9, 3 * 10**9 * S // 1000, "tick", "unblock", None),
    ]
    stream = files(spark, rows, EVENT, str(tmp_path / "in"), [[0, 2], [1, 5], [3, 4], [6, 7], [8]])
    query, out = run(expired_blocks(stream, "60 seconds"), tmp_path, spark)
    assert sorted((r.target_ip, r.version, r.expired_us // S) for r in out) == [("a", 2, 50), ("c", 6, 77), ("d", 7, 90), ("d", 8, 1095)]
