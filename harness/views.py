"""Engine inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators.alerts import threat_alerts
from flowtide.operators.scoring import Ensemble
from flowtide.plans.flow_records import flow_records
from flowtide.schemas import NUMERIC

# Timeouts scaled to the spacing of the test events: (flow, active) in seconds.
P1 = (6 * 3600.0, 24 * 3600.0)
P2 = (40 * 3600.0, 24 * 3600.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def event_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumns(
        {
            "ts_us": F.unix_micros(F.col("ts").cast("timestamp")),
            "k": F.regexp_extract("props", r"(\d+)", 1).cast("long"),
            "u": F.col("user_id"),
        }
    )


def packets(spark: SparkSession, sf: str) -> DataFrame:
    e = event_columns(spark, sf)
    kind, k = F.col("event_type"), F.col("k")
    fwd = kind.isin("signup", "view") | (kind.isin("click", "error") & (F.col("event_id") % 3 != 0))
    client = F.concat(
        F.lit("10.0."), F.expr("u div 200").cast("string"), F.lit("."), (F.col("u") % 200 + 1).cast("string")
    )
    cport = (20000 + F.col("u")).cast("int")
    server = F.concat(F.lit("10.1.0."), (F.col("u") % 7 + 1).cast("string"))
    sport = F.expr("cast(element_at(array(80, 443, 53, 22, 8080), cast(u % 5 as int) + 1) as int)")
    return e.select(
        F.col("event_id").alias("pkt_id"),
        "ts_us",
        F.when(fwd, client).otherwise(server).alias("src_ip"),
        F.when(fwd, server).otherwise(client).alias("dst_ip"),
        F.when(fwd, cport).otherwise(sport).alias("src_port"),
        F.when(fwd, sport).otherwise(cport).alias("dst_port"),
        F.when(F.col("u") % 5 == 2, "udp").otherwise("tcp").alias("proto"),
        (40 + F.floor("value")).cast("long").alias("length"),
        F.when(fwd, 64).otherwise(60).alias("ttl"),
        kind.isin("signup", "purchase").alias("syn"),
        kind.isin("view", "click", "purchase").alias("ack"),
        ((kind == "click") & (k % 10 == 0)).alias("fin"),
        ((kind == "error") & (k % 4 == 0)).alias("rst"),
        (kind == "click").alias("psh"),
        F.lit(False).alias("urg"),
        (1000 + k).cast("long").alias("tcp_seq"),
        (1024 * (k % 4)).cast("long").alias("tcp_window"),
    )


# The part of the labelled table that is written as expressions of the line item.
_LABELLED = {
    "id": "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000",
    "proto": "case l_linenumber % 3 when 0 then 'tcp' when 1 then 'udp' else ' arp' end",
    "service": "case l_returnflag when 'A' then 'http' when 'N' then '-' else 'dns ' end",
    "state": "case when l_orderkey % 10 = 9 then 'ACC' when l_linestatus = 'O' then 'FIN' "
    "when l_suppkey % 11 = 0 then '' else 'CON' end",
    "dur": "l_quantity * cast(0.01 as double)",
    "spkts": "cast(l_linenumber * 2 as double)",
    "dpkts": "cast(l_partkey % 40 as double)",
    "sbytes": "cast(floor(l_extendedprice) as double)",
    "dbytes": "cast(l_suppkey * 100 as double)",
    "rate": "cast(l_linenumber * 2 + l_partkey % 40 as double) / (l_quantity * cast(0.01 as double))",
    "sttl": "cast(case when l_partkey % 4 = 0 then 254 else 64 end as double)",
    "dttl": "cast(case when l_partkey % 3 = 0 then 252 else 60 end as double)",
}
_LABELLED_TARGETS = {
    "attack_cat": "case when not (l_returnflag = 'R' or l_quantity > 40) then 'Normal' "
    "when l_suppkey % 5 = 0 then 'DoS' when l_suppkey % 5 = 1 then 'Exploits' "
    "when l_suppkey % 5 = 2 then 'Reconnaissance' when l_suppkey % 5 = 3 then 'Fuzzers' else 'Generic' end",
    "label": "cast(case when l_returnflag = 'R' or l_quantity > 40 then 1 else 0 end as int)",
}


def labelled_expressions() -> dict[str, str]:
    """Column -> expression that Spark and the checking engine read alike."""
    rest = {}
    for i, name in enumerate(NUMERIC[8:]):
        value = f"cast((l_partkey * {i + 3} + l_linenumber) % {17 + i} as double)"
        rest[name] = "cast(0 as double)" if name == "is_ftp_login" else value
    return _LABELLED | rest | _LABELLED_TARGETS


def labelled_flows(spark: SparkSession, sf: str, split: str | None = None) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    if split == "train":
        rows = rows.filter("l_orderkey % 10 < 7")
    elif split == "test":
        rows = rows.filter("l_orderkey % 10 >= 7")
    return rows.selectExpr(*[f"{e} as {n}" for n, e in labelled_expressions().items()])


SCORE = "cast((l_partkey * 7) % 1000 as double) / cast(1000 as double)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with a stand-in attack probability ``p``."""
    exprs = labelled_expressions() | {"p": SCORE}
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in exprs.items()])


def alert_events(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of alerts: one alert per user, one version per event."""
    kind = F.col("event_type")
    prob = F.pmod(F.col("k") * 37, F.lit(100)) / F.lit(100.0)
    return event_columns(spark, sf).select(
        F.col("user_id").cast("string").alias("finding_id"),
        F.col("event_id").alias("version"),
        F.col("ts_us"),
        F.when(kind == "signup", "New")
        .when(kind.isin("view", "click"), "Investigating")
        .when(kind == "purchase", "Resolved")
        .alias("status"),
        prob.alias("probability_attack"),
        F.when(prob >= 0.9, "CRITICAL").when(prob >= 0.75, "HIGH").when(prob >= 0.6, "MEDIUM").otherwise("LOW").alias(
            "severity"
        ),
        F.when(kind == "error", F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("analyst_notes"),
        F.concat(
            F.lit('{"proto": "'), F.when(F.col("u") % 2 == 0, "tcp").otherwise("udp"), F.lit('", "k": '),
            F.col("k").cast("string"), F.lit("}"),
        ).alias("features_summary_json"),
    )


def block_events(spark: SparkSession, sf: str) -> DataFrame:
    """Block (with TTL) and unblock events per client address."""
    client = F.concat(
        F.lit("10.0."), F.expr("u div 200").cast("string"), F.lit("."), (F.col("u") % 200 + 1).cast("string")
    )
    return (
        event_columns(spark, sf)
        .filter(F.col("event_type").isin("error", "signup"))
        .select(
            F.col("event_id").alias("version"),
            F.col("ts_us").alias("created_us"),
            client.alias("target_ip"),
            F.when(F.col("event_type") == "error", "block").otherwise("unblock").alias("event"),
            F.when(F.col("event_type") == "error", F.col("k") * 60).alias("ttl_seconds"),
        )
    )


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    return event_columns(spark, sf).select(
        "event_id", "ts_us", "event_type", (F.col("value") / F.lit(1e4)).alias("seconds")
    )


# A small hand-written ensemble: (tree, node, feature, threshold, left, right, probs).
_TREES = [
    (0, 0, "syn_ratio", 0.4, 1, 2, None),
    (0, 1, "rate", 1.0, 3, 4, None),
    (0, 2, "dur", 1.0, 5, 6, None),
    (0, 3, None, None, None, None, [0.90, 0.02, 0.02, 0.02, 0.02, 0.02]),
    (0, 4, None, None, None, None, [0.50, 0.10, 0.10, 0.10, 0.10, 0.10]),
    (0, 5, None, None, None, None, [0.01, 0.95, 0.01, 0.01, 0.01, 0.01]),
    (0, 6, None, None, None, None, [0.04, 0.20, 0.10, 0.60, 0.03, 0.03]),
    (1, 0, "rate", 100.0, 1, 2, None),
    (1, 1, "syn_ratio", 0.6, 3, 4, None),
    (1, 2, "dur", 0.01, 5, 6, None),
    (1, 3, None, None, None, None, [0.80, 0.04, 0.04, 0.04, 0.04, 0.04]),
    (1, 4, None, None, None, None, [0.02, 0.10, 0.10, 0.70, 0.04, 0.04]),
    (1, 5, None, None, None, None, [0.02, 0.90, 0.02, 0.02, 0.02, 0.02]),
    (1, 6, None, None, None, None, [0.30, 0.30, 0.10, 0.10, 0.10, 0.10]),
    (2, 0, "dur", 0.5, 1, 2, None),
    (2, 1, "syn_ratio", 0.5, 3, 4, None),
    (2, 2, "syn_ratio", 0.7, 5, 6, None),
    (2, 3, None, None, None, None, [0.20, 0.20, 0.30, 0.10, 0.10, 0.10]),
    (2, 4, None, None, None, None, [0.03, 0.90, 0.03, 0.02, 0.01, 0.01]),
    (2, 5, None, None, None, None, [0.70, 0.06, 0.06, 0.06, 0.06, 0.06]),
    (2, 6, None, None, None, None, [0.05, 0.10, 0.10, 0.70, 0.03, 0.02]),
]
_NODE_FIELDS = ["tree", "node", "feature", "threshold", "left", "right", "probs"]


def manifest_rows() -> list[dict]:
    return [dict(zip(_NODE_FIELDS, r)) for r in _TREES]


def model() -> Ensemble:
    return Ensemble.from_rows(manifest_rows())


def records(spark: SparkSession, sf: str, p: tuple[float, float] = P1) -> DataFrame:
    return flow_records(packets(spark, sf), *p)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return threat_alerts(records(spark, sf), model())


def created_us() -> Column:
    return F.unix_micros(F.to_timestamp("timestamp"))
