"""Counts over the most recently flushed flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.ordered import number_rows
from flowtide.schemas import HISTORY

FLUSH_ORDER = ["close_us", "start_us", "flow_id", "flow_no"]
BLOCK = 8_192
# Blocks that one task sorts, on average.
TASK_BLOCKS = 4

# Count name -> columns that an earlier flow must share.
CONTEXT_KEYS = {
    "ct_srv_src": ["src_ip", "service"],
    "ct_state_ttl": ["state", "sttl"],
    "ct_dst_ltm": ["dst_ip"],
    "ct_src_dport_ltm": ["src_ip", "dst_port"],
    "ct_dst_sport_ltm": ["dst_ip", "src_port"],
    "ct_dst_src_ltm": ["src_ip", "dst_ip"],
}
# Defined in the labelled table only; no packet source produces them.
CONTEXT_KEYS_EXT = {"ct_src_ltm": ["src_ip"], "ct_srv_dst": ["dst_ip", "service"]}


def flush_sequence(flows: DataFrame) -> DataFrame:
    """Number flows in the order in which they close."""
    return number_rows(flows, FLUSH_ORDER, out="seq")


def recent_counts(
    flows: DataFrame,
    keys: dict[str, list[str]] = CONTEXT_KEYS,
    history: int = HISTORY,
    block: int = BLOCK,
) -> DataFrame:
    """1 + matches among the last ``history`` flows of the whole stream, for every key list.

    The sequence is cut into blocks of equal size, and each block also gets the last ``history`` rows
    of the one before. All counts then share one exchange on the block number, and a busy source is
    spread over blocks like every other. A block must not be shorter than the history.

    The rows are sorted anew for every key list, and all these sorts count as one task's memory. So the rows are dealt to as many
    tasks as their number asks for; by the size of the shuffled files, which compress well, Spark would join far more of them.
    """
    if block < history:
        raise ValueError(f"blocks of {block} rows can't hold a history of {history}")
    own = F.struct(F.floor(F.col("seq") / block).alias("block"), F.lit(True).alias("own"))
    halo = F.struct((F.floor(F.col("seq") / block) + 1).alias("block"), F.lit(False).alias("own"))
    in_halo = F.pmod(F.col("seq"), F.lit(block)) >= max(block - history, 0)
    copies = F.when(in_halo, F.array(own, halo)).otherwise(F.array(own))
    placed = flows.withColumn("_p", F.explode(copies)).withColumns(
        {"_block": F.col("_p.block"), "_own": F.col("_p.own")}
    )

    def matches(columns: list[str]) -> Column:
        recent = Window.partitionBy("_block", *columns).orderBy("seq").rangeBetween(-history, -1)
        return F.count(F.lit(1)).over(recent) + 1

    tasks = max(1, -(-flows.count() // (TASK_BLOCKS * block)))
    counted = placed.repartition(tasks, "_block").withColumns({n: matches(c) for n, c in keys.items()})
    return counted.filter("_own").drop("_p", "_block", "_own")


def context_counts(flows: DataFrame, block: int = BLOCK) -> DataFrame:
    return recent_counts(flush_sequence(flows), CONTEXT_KEYS, HISTORY, block)


def context_counts_ext(flows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The three context columns of the labelled table that extend the six of the flow record."""
    same = (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") == F.col("dst_port"))
    return recent_counts(flush_sequence(flows), CONTEXT_KEYS_EXT, HISTORY, block).withColumn(
        "is_sm_ips_ports", same.cast("int")
    )
