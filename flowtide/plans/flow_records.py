"""Packets to complete flow records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowtide.functions.ordered import HOT_ROWS
from flowtide.operators.context import BLOCK, context_counts
from flowtide.operators.flows import flow_measures
from flowtide.schemas import ACTIVE_TIMEOUT_S, FLOW_FEATURES, FLOW_IDENTITY, FLOW_TIMEOUT_S


def flow_records(
    packets: DataFrame,
    flow_timeout: float = FLOW_TIMEOUT_S,
    active_timeout: float = ACTIVE_TIMEOUT_S,
    hot_rows: int = HOT_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """The 45-column flow record, with ``seq``, ``start_us`` and ``close_us`` for ordering."""
    measured = flow_measures(packets, flow_timeout, active_timeout, hot_rows)
    return context_counts(measured, block).select(
        *FLOW_IDENTITY, *FLOW_FEATURES, "seq", "flow_no", "opener", "start_us", "close_us"
    )
