"""Keyed state with event-time timers: flows from a packet stream, and blocks that run out.

The state of a key is its own: a micro-batch touches the keys that have rows in it or a timer that is due, nothing else. State
is kept in RocksDB, so it may be larger than the executors' memory, and lists are appended to without being read.
Rows pass to and from Python one by one: a key has few in a batch, and a data frame for each key would cost more than its rows.
Rows may come in any order within the watermark's delay; Spark leaves out those that are later still.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from flowtide.functions.ordered import number_rows
from flowtide.operators.context import BLOCK, CONTEXT_KEYS, FLUSH_ORDER, recent_counts
from flowtide.operators.flows import KEY, flow_key, flow_measures
from flowtide.schemas import ACTIVE_TIMEOUT_S, FLOW_FEATURES, FLOW_IDENTITY, FLOW_TIMEOUT_S, HISTORY, PACKET
from flowtide.session import discard, materialise

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


# The packets of a key are stored in packs of this many at most: one entry is sent to the state store, not one for each packet.
PACK = 10_000
_PACK = "packets binary"


def _packed(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[k : k + PACK]),) for k in range(0, len(rows), PACK)]


def _unpacked(packs) -> list[tuple]:
    return [r for (pack,) in packs for r in pickle.loads(pack)]


def _due(us: int) -> int:
    """The timer, in milliseconds, that fires once the watermark is past a moment in microseconds."""
    return us // 1000 + 1


class FlowRelease(StatefulProcessor):
    """Gives out the packets of a flow, all together, as soon as the watermark has passed its end.

    Packets that the watermark has not reached wait in ``fresh``. Those it has passed go, in order, to the open flow, of which
    only start, last packet and end are looked at; its packets are read once, when it closes.
    """

    def __init__(self, flow_timeout: float, active_timeout: float):
        self.gap_us, self.active_us = (round(s * 1_000_000) for s in (flow_timeout, active_timeout))
        self.names, self.packet = PACKET.names, Row(*PACKET.names)
        self.ts, self.id, self.fin, self.rst = (self.names.index(c) for c in ("ts_us", "pkt_id", "fin", "rst"))

    def init(self, handle) -> None:
        self.handle = handle
        self.fresh = handle.getListState("fresh", _PACK)
        self.open = handle.getListState("open", _PACK)
        self.flow = handle.getValueState("flow", "start_us long, last_us long, ended boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        while part := [tuple(r[c] for c in self.names) for r in islice(rows, PACK)]:
            self.fresh.appendList(_packed(part))
            at = min(r[self.ts] for r in part)
            first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(_due(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(_unpacked(self.fresh.get()), key=lambda r: (r[self.ts], r[self.id])) if self.fresh.exists() else []
        ready = [r for r in waiting if _due(r[self.ts]) < watermark]
        later = waiting[len(ready) :]
        flow = tuple(self.flow.get()) if self.flow.exists() else None
        out, added = [], []
        for r in ready:
            if flow and (flow[2] or r[self.ts] - flow[1] >= self.gap_us):
                out += self._closed() + added
                flow, added = None, []
            start = flow[0] if flow else r[self.ts]
            flow = (start, r[self.ts], bool(r[self.fin] or r[self.rst] or r[self.ts] - start >= self.active_us))
            added.append(r)
        if flow:
            end = flow[1] if flow[2] else flow[1] + self.gap_us
            if _due(end) < watermark:
                out += self._closed() + added
                flow, added = None, []
            else:
                self.handle.registerTimer(_due(end))
        if added:
            self.open.appendList(_packed(added))
        if flow:
            self.flow.update(flow)
        else:
            self.flow.clear()
        if ready:
            self.fresh.put(_packed(later)) if later else self.fresh.clear()
        if later:
            self.handle.registerTimer(_due(later[0][self.ts]))
        return (self.packet(*r) for r in out)

    def _closed(self) -> list[tuple]:
        rows = _unpacked(self.open.get()) if self.open.exists() else []
        self.open.clear()
        return rows


def closed_flow_packets(
    packets: DataFrame, delay: str, flow_timeout: float = FLOW_TIMEOUT_S, active_timeout: float = ACTIVE_TIMEOUT_S
) -> DataFrame:
    """The packets of each flow, in the batch in which the watermark passes the flow's end. Append mode."""
    timed = flow_key(packets).select(*KEY[1:], *PACKET.names, F.timestamp_micros("ts_us").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy(*KEY[1:]).transformWithState(
        FlowRelease(flow_timeout, active_timeout), outputStructType=PACKET, outputMode="Append", timeMode="EventTime"
    )


class FlowStream:
    """Flow records from a packet stream, in ``path``/records.

    A batch measures the flows that closed in it with the batch code, numbers them on from the last one and counts their
    context in the latest HISTORY flows. Nothing else is carried from batch to batch, and a repeated batch overwrites its own output.
    """

    def __init__(
        self, spark: SparkSession, path: str, delay: str, flow_timeout: float = FLOW_TIMEOUT_S,
        active_timeout: float = ACTIVE_TIMEOUT_S, block: int = BLOCK,
    ):
        self.spark, self.path, self.delay, self.block = spark, path.rstrip("/"), delay, block
        self.timeouts = (flow_timeout, active_timeout)

    def start(self, packets: DataFrame, **trigger):
        with rocksdb(self.spark):
            return (
                closed_flow_packets(packets, self.delay, *self.timeouts).writeStream.foreachBatch(self.advance)
                .option("checkpointLocation", f"{self.path}/query").outputMode("append")
                .trigger(**(trigger or {"availableNow": True})).start()
            )

    def records(self) -> DataFrame:
        """Everything emitted so far."""
        return self.spark.read.parquet(f"{self.path}/records").drop("batch")

    def advance(self, released: DataFrame, batch: int) -> None:
        past = self._past(batch)
        # Written first: reading the batch twice would run the stateful operator twice.
        packets = materialise(released.select(*PACKET.names), "released")
        if packets.isEmpty():
            if past is not None:
                past.write.mode("overwrite").parquet(f"{self.path}/history/batch={batch}")
            discard(packets)
            return
        start = past.agg(F.max("seq")).first()[0] if past is not None else None
        measured = flow_measures(packets, *self.timeouts)
        closed = materialise(number_rows(measured, FLUSH_ORDER, out="seq", start=0 if start is None else start + 1), "closed")
        rows = closed.withColumn("_new", F.lit(True))
        if past is not None:
            rows = rows.unionByName(past.withColumn("_new", F.lit(False)))
        counted = recent_counts(rows, CONTEXT_KEYS, HISTORY, self.block).filter("_new")
        out = counted.select(*FLOW_IDENTITY, *FLOW_FEATURES, "seq", "opener", "start_us", "close_us")
        out.write.mode("overwrite").parquet(f"{self.path}/records/batch={batch}")
        latest = rows.drop("_new").orderBy(F.col("seq").desc()).limit(HISTORY)
        latest.write.mode("overwrite").parquet(f"{self.path}/history/batch={batch}")
        discard(packets, closed)

    def _past(self, batch: int) -> DataFrame | None:
        """The latest flows before a batch: at most HISTORY rows."""
        try:
            return self.spark.read.parquet(f"{self.path}/history/batch={batch - 1}")
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err):
                return None
            raise


BLOCK_EVENT = "version long, created_us long, event string, ttl_seconds long"
EXPIRY = "target_ip string, version long, created_us long, ttl_seconds long, expired_us long"
_EXPIRED = Row("target_ip", "version", "created_us", "ttl_seconds", "expired_us")


class BlockExpiry(StatefulProcessor):
    """Lists each block once when it has run out, unless a later event of its address came first. A block without time runs out at once.

    An address keeps the events that can still matter: blocks in force and what the watermark has not passed.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", BLOCK_EVENT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [(r["version"], r["created_us"], r["event"], r["ttl_seconds"]) for r in rows]
        if found:
            self.events.appendList(found)
            self.handle.registerTimer(_due(min(r[1] for r in found)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(r) for r in self.events.get()), key=lambda r: (r[1], r[0])) if self.events.exists() else []
        out, kept, timers = [], [], []
        for k, (version, created, event, ttl) in enumerate(events):
            until = created + (ttl or 0) * 1_000_000 if event == "block" else created
            replaced = k + 1 < len(events) and events[k + 1][1] < until
            if _due(created) >= watermark:  # earlier events of the address may still come
                kept.append(events[k])
                timers.append(_due(created))
            elif event == "block" and not replaced:
                if _due(until) < watermark:
                    out.append((key[0], version, created, ttl, until))
                else:
                    kept.append(events[k])
                    timers.append(_due(until))
        if len(kept) < len(events):
            self.events.put(kept) if kept else self.events.clear()
        if timers:
            self.handle.registerTimer(min(timers))
        return (_EXPIRED(*r) for r in out)


def expired_blocks(events: DataFrame, delay: str) -> DataFrame:
    """(target_ip, version, created_us, ttl_seconds, expired_us) of every block that ran out, once. Append mode."""
    timed = events.withColumn("at", F.timestamp_micros("created_us")).withWatermark("at", delay)
    return timed.groupBy("target_ip").transformWithState(
        BlockExpiry(), outputStructType=EXPIRY, outputMode="Append", timeMode="EventTime"
    )
