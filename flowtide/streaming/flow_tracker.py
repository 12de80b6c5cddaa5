"""Flow records from a packet stream.

Every micro-batch runs the batch code on the new packets together with the packets of flows that were
still open, emits the flows that can no longer change, and keeps the packets of the others. Batch and
stream therefore agree by construction. What is kept is bounded by the active timeout.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from flowtide.functions.ordered import HOT_ROWS, number_rows
from flowtide.operators.context import BLOCK, CONTEXT_KEYS, FLUSH_ORDER, recent_counts
from flowtide.operators.flows import FLOW, close_time, flow_packets, measures_of
from flowtide.schemas import ACTIVE_TIMEOUT_S, FLOW_FEATURES, FLOW_IDENTITY, FLOW_TIMEOUT_S, HISTORY, PACKET

_PROGRESS = "batch long, watermark_us long, next_seq long, late long"
_END = (1 << 62)


@dataclass(frozen=True)
class Progress:
    batch: int = -1
    watermark_us: int = -_END
    next_seq: int = 0
    late: int = 0


class FlowTracker:
    """``advance`` is the ``foreachBatch`` function; a repeated batch overwrites its own output.

    ``delay`` is how many seconds packets may come behind the latest one seen: flows are held back that long. Packets
    that are later still can't change what is out; they are counted and kept in a table of their own (``late``).
    """

    def __init__(
        self, spark: SparkSession, path: str, delay: float, flow_timeout: float = FLOW_TIMEOUT_S,
        active_timeout: float = ACTIVE_TIMEOUT_S, hot_rows: int = HOT_ROWS, block: int = BLOCK,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.timeouts = (flow_timeout, active_timeout)
        self.delay_us = int(delay * 1_000_000)
        self.hot_rows, self.block = hot_rows, block

    def start(self, packets: DataFrame, **trigger):
        return (
            packets.writeStream.foreachBatch(self.advance)
            .option("checkpointLocation", f"{self.path}/query")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def records(self) -> DataFrame:
        """Everything emitted so far."""
        return self.spark.read.parquet(f"{self.path}/records").drop("batch")

    def late(self) -> DataFrame:
        """Packets that came too late for their flow, with the batch that brought them."""
        return self.spark.read.schema(StructType([*PACKET.fields, StructField("batch", IntegerType())])).parquet(f"{self.path}/late")

    def progress(self, before: int | None = None) -> Progress:
        """State after the last batch (before the given one)."""
        try:
            rows = self.spark.read.schema(_PROGRESS).json(f"{self.path}/progress")
        except Exception as err:
            if "PATH_NOT_FOUND" in str(err):
                return Progress()
            raise
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        last = rows.orderBy(F.col("batch").desc()).limit(1).collect()
        return Progress(*[last[0][f.name] for f in fields(Progress)]) if last else Progress()

    def finish(self) -> None:
        """Flush the flows that are still open, as at the end of the input."""
        last = self.progress()
        nothing = self.spark.createDataFrame([], PACKET)
        self._step(nothing, last.batch + 1, final=True)

    def advance(self, packets: DataFrame, batch: int) -> None:
        self._step(packets, batch, final=False)

    def _part(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def _store(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        path = self._part(kind, batch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _step(self, packets: DataFrame, batch: int, final: bool) -> None:
        last = self.progress(before=batch)
        arrived = packets.select(*PACKET.names)
        in_time = F.col("ts_us") >= last.watermark_us
        rows = arrived.filter(in_time)
        if last.batch >= 0:
            rows = rows.unionByName(self.spark.read.schema(PACKET).parquet(self._part("open", last.batch)))
        placed = self._store(flow_packets(rows, *self.timeouts, self.hot_rows), "placed", batch)

        latest = placed.agg(F.max("ts_us")).first()[0]
        watermark = _END if final else max(last.watermark_us, (latest or -_END) - self.delay_us)
        ends = (
            placed.groupBy(*FLOW)
            .agg(
                F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"),
                F.max_by((F.col("fin") | F.col("rst")).cast("int"), "pos").alias("ended"),
            )
            .filter(close_time(*self.timeouts) >= watermark)
        )
        still_open = placed.join(ends.select(*FLOW), FLOW, "left_semi").select(*PACKET.names)
        self._store(still_open, "open", batch)

        closed = measures_of(placed, *self.timeouts).filter(F.col("close_us") < watermark)
        fresh = number_rows(closed, FLUSH_ORDER, out="seq", start=last.next_seq)
        with_past = fresh.withColumn("_new", F.lit(True))
        if last.batch >= 0:
            past = self.spark.read.schema(fresh.schema).parquet(self._part("history", last.batch))
            with_past = with_past.unionByName(past.withColumn("_new", F.lit(False)))
        counted = recent_counts(with_past, CONTEXT_KEYS, HISTORY, self.block).filter("_new")
        out = counted.select(*FLOW_IDENTITY, *FLOW_FEATURES, "seq", "opener", "start_us", "close_us")
        emitted = self._store(out, "records", batch).count()
        # The flows that later ones look back on: at most HISTORY rows.
        self._store(with_past.drop("_new").orderBy(F.col("seq").desc()).limit(HISTORY), "history", batch)
        late = self._store(arrived.filter(~in_time), "late", batch).count()
        state = [(batch, watermark, last.next_seq + emitted, last.late + late)]
        self.spark.createDataFrame(state, _PROGRESS).coalesce(1).write.mode("overwrite").json(
            f"{self.path}/progress/run={batch}"
        )
