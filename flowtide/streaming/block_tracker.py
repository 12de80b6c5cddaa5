"""The block list as a stream: current blocks, and the addresses whose block ran out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "version long, created_us long, target_ip string, event string, ttl_seconds long"
STATE = f"{EVENT}, listed boolean"


class BlockTracker:
    """Keeps, for each address, the events that can still matter.

    ``advance`` is the ``foreachBatch`` function; a repeated batch overwrites its own output. A block runs out
    unless a later event of its address comes first; each is listed once, wherever the batches end. The latest event of an
    address stays while it is a block in force, and otherwise for ``delay`` seconds, so that a block that arrives late
    doesn't come back to life; so the state does not grow with time.
    """

    def __init__(self, spark: SparkSession, path: str, delay: float = 86_400.0):
        self.spark, self.path, self.delay_us = spark, path.rstrip("/"), int(delay * 1_000_000)

    def start(self, events: DataFrame, **trigger):
        return (
            events.writeStream.foreachBatch(self.advance)
            .option("checkpointLocation", f"{self.path}/query")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def _read(self, kind: str, batch: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/{kind}/batch={batch}")

    def advance(self, events: DataFrame, batch: int) -> None:
        new = events.select(*[c.split()[0] for c in EVENT.split(", ")], F.lit(False).alias("listed"))
        known = new if batch == 0 else new.unionByName(self._read("state", batch - 1))
        now = known.agg(F.max("created_us")).first()[0]
        after = Window.partitionBy("target_ip").orderBy("created_us", "version")
        until = F.col("created_us") + F.col("ttl_seconds") * 1_000_000
        placed = known.withColumns({"next_us": F.lead("created_us").over(after), "until": until})
        block = F.col("event") == "block"
        over = block & (F.col("until") <= F.lit(now)) & (F.col("next_us").isNull() | (F.col("next_us") >= F.col("until")))
        placed = placed.withColumn("over", F.coalesce(over, F.lit(False)))
        names = [c.split()[0] for c in STATE.split(", ")]
        placed.filter("over and not listed").select(*names).write.mode("overwrite").parquet(f"{self.path}/expired/batch={batch}")
        matters = (block & ~F.col("over")) | (F.col("created_us") >= F.lit((now or 0) - self.delay_us))
        kept = placed.filter(F.col("next_us").isNull() & matters).withColumn("listed", F.col("listed") | F.col("over"))
        kept.select(*names).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")

    def active(self, batch: int) -> DataFrame:
        return self._read("state", batch).filter("event = 'block' and not listed")

    def expired(self) -> DataFrame:
        """Every block that ran out, with the batch that noticed it; one row an event."""
        return self.spark.read.parquet(f"{self.path}/expired")
