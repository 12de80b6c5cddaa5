"""Reading and writing flows, alerts, rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.operators.alerts import list_alerts
from flowtide.schemas import ALERT, ALERT_CSV_COLUMNS, EVIDENCE_TYPE, FLOW, LABELLED_FLOW

CORRUPT = "_corrupt"


def scan_labelled_flows(spark: SparkSession, path: str, schema: T.StructType = LABELLED_FLOW) -> DataFrame:
    """Labelled flows from CSV with a header, columns in any order; unreadable lines are kept in ``_corrupt``.

    Columns are found by name and typed by the schema; all files have the header of the first. Columns that the schema
    doesn't know are left out, missing ones are an error.
    """
    # Without a schema, reading one line of the header costs no pass over the data.
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    known = {f.name: f for f in schema.fields}
    missing = [n for n in known if n not in header]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    found = [known.get(n, T.StructField(n, T.StringType())) for n in header]
    with_corrupt = T.StructType([*found, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(with_corrupt)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .option("nullValue", "\\N")
        .csv(path)
    )
    return rows.select(*known, CORRUPT)


def write_labelled_flows(rows: DataFrame, path: str) -> None:
    """The same layout; an empty text is written as a quoted empty field, a null as \\N."""
    rows.write.option("header", True).option("nullValue", "\\N").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def encode_telemetry(flows: DataFrame) -> DataFrame:
    """Flow to message: the source address as key (null if empty), the record as JSON value."""
    return flows.select(
        F.nullif(F.col("src_ip"), F.lit("")).alias("key"), F.to_json(F.struct(*flows.columns)).alias("value")
    )


def decode_telemetry(messages: DataFrame, schema: T.StructType = FLOW) -> DataFrame:
    """Message to flow: missing numbers become 0, missing text the usual defaults. Batch or stream."""
    text = {"src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "proto": "tcp"}
    parsed = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("f"))

    def filled(f: T.StructField):
        value = F.col(f"f.{f.name}")
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(value, F.lit(text[f.name])) if f.name in text else value
        return F.coalesce(value, F.lit(0).cast(f.dataType))

    return parsed.select(*[filled(f).alias(f.name) for f in schema.fields])


def write_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").option("compression", "gzip").json(path)


def scan_alerts(spark: SparkSession, path: str, evidence: T.StructType = EVIDENCE_TYPE) -> DataFrame:
    """Stored alerts with parsed evidence; evidence that is no JSON becomes an empty record."""
    return parse_evidence(spark.read.schema(ALERT).parquet(path), evidence)


def parse_evidence(alerts: DataFrame, evidence: T.StructType = EVIDENCE_TYPE) -> DataFrame:
    empty = F.from_json(F.lit("{}"), evidence)
    parsed = F.coalesce(F.from_json("features_summary_json", evidence), empty)
    return alerts.withColumn("features_summary", parsed).withColumn(
        "analyst_notes", F.coalesce("analyst_notes", F.lit(""))
    )


def export_alerts_csv(alerts: DataFrame, path: str, newest: str = "timestamp", limit: int | None = None) -> None:
    """All alerts, newest first, as a CSV report with fixed columns; ``limit`` keeps the newest only."""
    page = list_alerts(alerts, limit=limit, newest=newest)
    page.select(*ALERT_CSV_COLUMNS).write.option("header", True).csv(path)


def write_report(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.json(path)


def append_rules(rules: DataFrame, path: str) -> None:
    """Append rule lines; one folder per engine."""
    rules.select("engine", "rule_text").write.mode("append").partitionBy("engine").text(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule lines, stripped; blank lines and lines that begin with # are left out."""
    line = F.col("value")
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    return spark.read.text(path).filter((text != "") & ~F.startswith(line, F.lit("#"))).select(text.alias("rule_text"))


def highest_sid(rules: DataFrame) -> int | None:
    """Highest rule id in use."""
    return rules.agg(F.max(F.regexp_extract("rule_text", r"sid:(\d+)", 1).cast("long"))).first()[0]
