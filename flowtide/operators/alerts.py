"""Threat alerts, findings, and the alert table with its triage operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import count_when, iso_utc, round_even
from flowtide.operators.scoring import Ensemble, attribute, binary_decision, drop_leaves, score
from flowtide.schemas import (
    ANOMALY_THRESHOLD,
    CRITICAL_THRESHOLD,
    DETECTION_THRESHOLD,
    EVIDENCE,
    FLOW_FEATURES,
    FLOW_IDENTITY,
    STATUSES,
)

PAGE_MOST = 500  # rows of a page of the alert list


def threat_filter(scored: DataFrame, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    return scored.filter(F.col("anomaly_prob") >= F.lit(threshold))


def threat_alerts(flows: DataFrame, model: Ensemble, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Flows to alerts: score, keep those at or above the threshold, then attribute only those.

    An alert's id is made of the flow, its start and its first packet (``opener``) where they are known, so a
    stream, a batch and a later batch over more input give a flow the same id.
    """
    hits = drop_leaves(attribute(threat_filter(score(flows, model), threshold), model))
    prob = F.col("anomaly_prob")
    telemetry = [c for c in [*FLOW_IDENTITY, *FLOW_FEATURES] if c in flows.columns]
    flow_id = F.coalesce("flow_id", F.concat_ws(":", "src_ip", F.col("src_port").cast("string")))
    once = [flow_id, F.col("timestamp")] + [F.col(c).cast("string") for c in ("start_us", "opener") if c in flows.columns]
    return hits.select(
        F.sha2(F.concat_ws("|", *once), 256).alias("alert_id"),
        "timestamp",
        flow_id.alias("flow_id"),
        F.coalesce("src_ip", F.lit("0.0.0.0")).alias("src_ip"),
        F.coalesce("dst_ip", F.lit("0.0.0.0")).alias("dst_ip"),
        F.coalesce("src_port", F.lit(0)).cast("int").alias("src_port"),
        F.coalesce("dst_port", F.lit(0)).cast("int").alias("dst_port"),
        F.coalesce("proto", F.lit("tcp")).alias("proto"),
        F.when(F.col("predicted") == "Normal", "Generic").otherwise(F.col("predicted")).alias("attack_cat"),
        round_even(prob, 4).alias("anomaly_prob"),
        "primary_contributing_feature",
        F.map_from_entries(
            F.transform("contributors", lambda e: F.struct(e["feature"], round_even(e["value"], 4)))
        ).alias("attributions"),
        F.when(prob >= CRITICAL_THRESHOLD, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.struct(*telemetry).alias("raw_telemetry"),
    )


def severity_tier(is_alert: Column, prob: Column) -> Column:
    p = F.coalesce(prob, F.lit(1.0))
    return (
        F.when(~is_alert, "INFORMATIONAL")
        .when(p >= 0.90, "CRITICAL")
        .when(p >= 0.75, "HIGH")
        .when(p >= 0.60, "MEDIUM")
        .otherwise("LOW")
    )


def evidence(columns: list[str]) -> Column:
    """Key indicators of the flow; indicators the input lacks are left out."""
    return F.struct(*[c for c in EVIDENCE if c in columns])


def security_findings(
    rows: DataFrame,
    threshold: float = DETECTION_THRESHOLD,
    prob: str | None = "p",
    model_name: str = "model",
    now: Column | None = None,
    finding_id: Column | None = None,
) -> DataFrame:
    """One finding per scored flow; a batch shares one timestamp."""
    decided = binary_decision(rows, threshold, prob)
    stamp = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    p = F.col(prob) if prob else F.lit(None).cast("double")
    return decided.select(
        (finding_id if finding_id is not None else F.expr("uuid()")).alias("finding_id"),
        stamp.alias("timestamp"),
        F.col("predicted_label").alias("prediction"),
        F.col("predicted_class").alias("label"),
        (F.col("probability_attack") if prob else p).alias("probability_attack"),
        "confidence",
        "is_alert",
        severity_tier(F.col("is_alert"), p).alias("severity"),
        F.lit(model_name).alias("model_name"),
        "threshold_used",
        evidence(rows.columns).alias("features_summary"),
    )


def as_alert_versions(findings: DataFrame, version: Column, status: str = "New", notes: str = "") -> DataFrame:
    """Findings that are alerts, as rows of the alert table."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return findings.filter("is_alert").select(
        *[c for c in findings.columns if c != "features_summary"],
        F.to_json("features_summary").alias("features_summary_json"),
        F.lit(status).alias("status"),
        F.lit(notes).alias("analyst_notes"),
        F.col("timestamp").alias("updated_at"),
        version.alias("version"),
    )


def latest_versions(versions: DataFrame, key: str = "finding_id", version: str = "version") -> DataFrame:
    """Current row of every alert: the whole latest version, status and notes included.

    An aggregate with map-side combine, so an alert with very many versions is no hot spot.
    """
    others = [c for c in versions.columns if c != key]
    latest = F.max_by(F.struct(*others), F.col(version)).alias("_v")
    return versions.groupBy(key).agg(latest).select(key, *[F.col(f"_v.{c}").alias(c) for c in others])


def upsert(current: DataFrame, incoming: DataFrame, key: str = "finding_id") -> DataFrame:
    """Merge by id: an incoming row replaces the whole stored row. A missing status means New."""
    ready = incoming.withColumn("status", F.coalesce("status", F.lit("New")))
    return latest_versions(current.unionByName(ready, allowMissingColumns=True), key)


def lookup_alert(alerts: DataFrame, finding_id: str) -> DataFrame:
    return alerts.filter(F.col("finding_id") == finding_id)


def list_alerts(
    alerts: DataFrame,
    status: str | None = None,
    severity: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
    newest: str = "timestamp",
) -> DataFrame:
    """One page of alerts, newest first, of at most PAGE_MOST; ``limit`` None for all of them."""
    if limit is not None and not 0 < limit <= PAGE_MOST or offset < 0:
        raise ValueError(f"a page needs a limit from 1 to {PAGE_MOST} and no negative offset")
    if status is not None:
        alerts = alerts.filter(F.col("status") == status)
    if severity is not None:
        alerts = alerts.filter(F.col("severity") == severity)
    ordered = alerts.orderBy(F.col(newest).desc(), "finding_id")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def update_alerts(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply updates (finding_id, version, status, analyst_notes, updated_at) to the current rows.

    A null field leaves the stored value; notes are overwritten; ids without an alert change nothing.
    The latest given value of each field wins. Updates older than the stored version are left out; statuses that
    are not allowed are an error.
    """
    allowed = F.col("status").isNull() | F.col("status").isin(STATUSES)
    wrong = F.concat(F.lit("status not allowed: "), F.col("status"))
    updates = updates.withColumn("status", F.when(allowed, F.col("status")).otherwise(F.raise_error(wrong)))
    stored = alerts.select("finding_id", F.col("version").alias("_stored"))
    updates = updates.join(stored, "finding_id").where("version >= _stored")

    def last_given(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("version")))

    per_alert = updates.groupBy("finding_id").agg(
        last_given("status").alias("_status"),
        last_given("analyst_notes").alias("_notes"),
        F.max_by("updated_at", "version").alias("_updated_at"),
        F.max("version").alias("_version"),
    )
    return (
        alerts.join(per_alert, "finding_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "analyst_notes": F.coalesce("_notes", "analyst_notes"),
                "updated_at": F.coalesce("_updated_at", "updated_at"),
                "version": F.coalesce("_version", "version"),
            }
        )
        .select(*alerts.columns)
    )


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Total, count per status (0 if absent) and high-priority count in one pass."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[count_when(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES],
        count_when(F.col("severity").isin("CRITICAL", "HIGH")).alias("high_priority_count"),
    )


def recent_alerts(alerts: DataFrame, n: int = 10, newest: str = "timestamp") -> DataFrame:
    """The overview table: short id, percent confidence, two fields of the evidence."""

    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object("features_summary_json", f"$.{name}"), F.lit("-"))

    return list_alerts(alerts, limit=n, newest=newest).select(
        F.concat(F.substring("finding_id", 1, 8), F.lit("...")).alias("id"),
        F.col(newest).alias("timestamp"),
        "label",
        F.format_string("%.1f%%", F.col("confidence") * 100).alias("confidence"),
        "severity",
        "status",
        field("proto").alias("proto"),
        field("service").alias("service"),
    )


def event_time(us: Column) -> Column:
    return iso_utc(us)
