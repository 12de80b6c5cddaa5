"""Windowed counts over streams, with Spark's own watermark and state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators.alerts import threat_alerts
from flowtide.operators.scoring import Ensemble
from flowtide.schemas import ANOMALY_THRESHOLD


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


def windowed_counts(
    rows: DataFrame, keys: Sequence[str], width: str, slide: str | None = None, delay: str = "10 seconds"
) -> DataFrame:
    """Counts per window; a window is emitted once the watermark has passed it."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = _timed(rows, delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_micros("w.start").alias("window_us"), *keys, "n")


def rate_hits_stream(packets: DataFrame, hits: int, seconds: float, delay: str = "10 seconds") -> DataFrame:
    """Sources that reach the rate limit in a window."""
    counts = windowed_counts(packets, ["src_ip"], f"{int(seconds * 1000)} milliseconds", None, delay)
    return counts.filter(F.col("n") >= hits).withColumnRenamed("n", "hits")


def alert_stream(flows: DataFrame, model: Ensemble, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Scoring keeps no state, so the batch operator runs on the stream as it is."""
    return threat_alerts(flows, model, threshold)
