"""The life cycles from end to end: packets to responses, and labelled rows to findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.alerts import as_alert_versions, security_findings, threat_alerts
from flowtide.operators.cleaning import split_valid
from flowtide.operators.response import assign_sids, block_entries, ids_rules, mitigation_events
from flowtide.operators.scoring import Ensemble
from flowtide.plans.flow_records import flow_records
from flowtide.schemas import ACTIVE_TIMEOUT_S, ANOMALY_THRESHOLD, DETECTION_THRESHOLD, FLOW_TIMEOUT_S, ROW_ID
from flowtide.session import materialise
from flowtide.sources.models import Bundle


@dataclass(frozen=True)
class Responses:
    alerts: DataFrame
    rules: DataFrame
    blocks: DataFrame
    events: DataFrame


def packet_alerts(
    packets: DataFrame, model: Ensemble, threshold: float = ANOMALY_THRESHOLD,
    flow_timeout: float = FLOW_TIMEOUT_S, active_timeout: float = ACTIVE_TIMEOUT_S,
) -> DataFrame:
    """Packets to flow records to threat alerts."""
    return threat_alerts(flow_records(packets, flow_timeout, active_timeout), model, threshold)


def respond(alerts: DataFrame, highest_sid: int | None = None) -> Responses:
    """Rules, block entries and mitigation events of a set of alerts.

    The numbered alerts are written once, as all three are made from them.
    """
    numbered = materialise(assign_sids(alerts, ["timestamp", "flow_id", "alert_id"], highest=highest_sid), "alerts")
    at = F.to_timestamp("timestamp")
    created_us = F.unix_micros(at)
    return Responses(
        numbered,
        ids_rules(numbered, F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'")),
        block_entries(numbered, created_us),
        mitigation_events(numbered, created_us),
    )


def score_rows(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """Rows with the attack probability ``p`` of a stored classifier; the raw columns stay."""
    raw = F.struct(*rows.columns).alias("_raw")
    ready = bundle.preprocessor.vectors(rows.withColumn("_raw", raw), ["_raw"])
    return bundle.model.transform(ready).select("_raw.*", vector_to_array("probability")[1].alias("p"))


def find(
    raw: DataFrame, bundle: Bundle, version: Column, threshold: float = DETECTION_THRESHOLD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, new alert versions, quarantined rows) of a batch of unchecked rows."""
    valid, quarantine = split_valid(raw)
    ids = F.sha2(F.concat_ws("|", F.lit(bundle.model_name), F.col(ROW_ID).cast("string")), 256) if ROW_ID in raw.columns else None
    findings = security_findings(
        score_rows(valid, bundle), threshold, model_name=bundle.model_name, finding_id=ids
    )
    return findings, as_alert_versions(findings, version), quarantine
