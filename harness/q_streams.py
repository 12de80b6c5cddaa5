"""Queries that run as streams: the table arrives in files, out of order within a bound, and the result is what was emitted."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.session import shared_folder
from flowtide.streaming.alert_table import AlertTable
from flowtide.streaming.keyed import FlowStream, expired_blocks, rocksdb
from harness import views as V
from harness.q_alerts import _COLS
from harness.q_flows import RECORD, quoted
from harness.registry import query
from harness.sql import on_alerts, on_blocks, on_records

FILES = 4
HOUR_US = 3_600_000_000
DELAY = "2 hours"  # rows come up to an hour late


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/flowtide/streams/{uuid.uuid4().hex}"


def arriving(rows: DataFrame, path: str, at: str, late_by: Column, last: dict[str, Column]) -> DataFrame:
    """The rows as a stream of FILES files, in order of arrival: event time plus a delay below an hour.

    A last file with one row far in the future (``last`` replaces its key) lets the watermark pass all others.
    """
    spark = rows.sparkSession
    come = rows.withColumn("_at", F.col(at) + late_by)
    cuts = come.agg(F.percentile_approx("_at", [k / FILES for k in range(1, FILES)], 10_000)).first()[0]
    for k in range(FILES):  # one after the other: a file stream goes by file times
        inside = F.lit(True)
        if k:
            inside &= F.col("_at") > cuts[k - 1]
        if k < FILES - 1:
            inside &= F.col("_at") <= cuts[k]
        come.where(inside).drop("_at").coalesce(1).write.mode("append").parquet(path)
    tick = rows.orderBy(F.col(at).desc()).limit(1).withColumns({at: F.col(at) + 100_000 * F.lit(HOUR_US), **last})
    tick.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("flow_features_stream", on_records(f"select {quoted(RECORD)}, seq from rec", p=V.P2))
def _features_stream(spark, sf):
    """The records of flow_features_active, each emitted once its flow can no longer change."""
    path = work_folder(spark)
    packets = V.packets(spark, sf)
    stream = arriving(packets, f"{path}/in", "ts_us", F.pmod(F.col("pkt_id") * 7919, F.lit(HOUR_US)), {"src_ip": F.lit("tick")})
    flows = FlowStream(spark, f"{path}/flows", DELAY, *V.P2)
    flows.start(stream).awaitTermination()
    return flows.records().select(*RECORD, "seq")


@query("blocks_expired_stream", on_blocks("""
select target_ip, version, created_us, ttl_seconds, until as expired_us
from (select *, created_us + coalesce(ttl_seconds, 0) * 1000000 as until, lead(created_us) over (partition by target_ip order by created_us, version) as next_us from be)
where event = 'block' and (next_us is null or next_us >= until)"""))
def _expired_stream(spark, sf):
    """Every block that ran out before its address had another event, listed once."""
    path = work_folder(spark)
    events = V.block_events(spark, sf)
    stream = arriving(events, f"{path}/in", "created_us", F.pmod(F.col("version") * 7919, F.lit(HOUR_US)), {"target_ip": F.lit("tick")})
    with rocksdb(spark):
        out = (
            expired_blocks(stream, DELAY).writeStream.format("parquet").option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/query").outputMode("append").trigger(availableNow=True).start()
        )
    out.awaitTermination()
    return spark.read.parquet(f"{path}/out")


BATCHES = 10
_ARRIVAL = f"version * 7919 % {BATCHES}"


def alert_batches(spark: SparkSession, sf: str) -> AlertTable:
    """The alert versions in ten batches, in no order of versions."""
    alerts = AlertTable(spark, f"{work_folder(spark)}/alerts", buckets=16)
    versions = V.alert_events(spark, sf)
    for batch in range(BATCHES):
        alerts.apply(versions.where(f"{_ARRIVAL} = {batch}"), batch)
    return alerts


@query("alert_lookup_bucket", on_alerts(f"select {quoted(_COLS)} from cur where finding_id = '42'"))
def _lookup_bucket(spark, sf):
    """One bucket is read."""
    return alert_batches(spark, sf).lookup("42").select(*_COLS)


@query("alert_stats_incremental", on_alerts("""
select batch, count(*) as total_alerts, count(*) filter (status = 'New') as n_new, count(*) filter (status = 'Investigating') as n_investigating,
  count(*) filter (status = 'Resolved') as n_resolved, count(*) filter (severity in ('CRITICAL', 'HIGH')) as high_priority_count
from upto group by batch""", (f"""
upto as (select batch, finding_id, coalesce(status, 'New') as status, severity
  from av join (select unnest(range({BATCHES})) as batch) b on {_ARRIVAL} <= batch
  qualify row_number() over (partition by batch, finding_id order by version desc) = 1)""",)))
def _stats_incremental(spark, sf):
    """The statistics after each batch, from counts that only the rows of a batch change."""
    alerts = alert_batches(spark, sf)
    each = [alerts.statistics(batch).withColumn("batch", F.lit(batch).cast("long")) for batch in range(BATCHES)]
    return reduce(DataFrame.unionByName, each)
