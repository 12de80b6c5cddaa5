"""Detection-rule text, rate limits and the time-limited block list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import iso_utc, lookup
from flowtide.functions.ordered import HOT_ROWS, PIECE, SLOT, Lane, cut, number_rows, scan, split_hot
from flowtide.schemas import BASE_SID, BLOCK_TTL_S, CLASSTYPES, RATE_LIMITS

ENGINES = ["snort3", "suricata"]
TAG = "flowtide"


def classtype_of(category: Column) -> Column:
    return lookup(category, CLASSTYPES, "bad-traffic")


def assign_sids(alerts: DataFrame, order: list[str], base: int = BASE_SID, highest: int | None = None) -> DataFrame:
    """Number alerts with rule ids, going on after the highest id in use. ``order`` must be unique."""
    start = base if highest is None else max(base, highest + 1)
    return number_rows(alerts, order, out="sid", start=start)


def _threshold(kind: str) -> Column:
    text = F.lit(None).cast("string")
    for category, (hits, seconds) in RATE_LIMITS.items():
        clause = f"threshold:type {kind}, track by_src, count {hits}, seconds {seconds}"
        text = F.when(F.col("_cat") == category, F.lit(clause)).otherwise(text)
    return text


def ids_rules(alerts: DataFrame, created: Column, tag: str = TAG) -> DataFrame:
    """Two rules per alert with a ``sid``: one for each engine. ``created``: text of the rule time."""
    named = alerts.withColumns(
        {
            "_cat": F.coalesce("attack_cat", F.lit("Generic")),
            "_why": F.coalesce("primary_contributing_feature", F.lit("traffic_anomaly")),
            "_prob": F.coalesce("anomaly_prob", F.lit(0.95)),
            "_src": F.coalesce("src_ip", F.lit("$EXTERNAL_NET")),
            "_created": created,
        }
    )
    proto = F.lower(F.coalesce("proto", F.lit("tcp")))
    head = F.concat(
        F.lit("alert "),
        F.when(proto.isin("tcp", "udp", "icmp", "ip"), proto).otherwise(F.lit("ip")),
        F.lit(" "), F.col("_src"), F.lit(" "),
        F.coalesce(F.col("src_port").cast("string"), F.lit("any")),
        F.lit(" -> "), F.coalesce("dst_ip", F.lit("$HOME_NET")), F.lit(" "),
        F.coalesce(F.col("dst_port").cast("string"), F.lit("any")),
    )

    def rule(*options: Column) -> Column:
        # concat_ws leaves out the threshold clause where there is none.
        return F.concat(head, F.lit(" ( "), F.concat_ws("; ", *options), F.lit("; )"))

    classtype = F.concat(F.lit("classtype:"), classtype_of(F.col("_cat")))
    sid = F.concat(F.lit("sid:"), F.col("sid").cast("string"))
    texts = {
        "snort3": rule(
            F.concat(F.lit(f'msg:"[{tag}] '), F.col("_cat"), F.lit(" Attack Detected (Root-Cause: "), F.col("_why"), F.lit(')"')),
            classtype, sid, F.lit("rev:1"),
            F.concat(
                F.lit("metadata:created_at "), F.col("_created"), F.lit(", confidence "),
                F.format_string("%.2f", "_prob"), F.lit(f", engine {tag}_v1"),
            ),
            _threshold("both"),
        ),
        "suricata": rule(
            F.concat(F.lit(f'msg:"[{tag}] '), F.col("_cat"), F.lit(" Anomaly (Attr: "), F.col("_why"), F.lit(')"')),
            F.lit("flow:to_server"), classtype, sid, F.lit("rev:1"),
            _threshold("threshold"),
        ),
    }
    both = F.array(*[F.struct(F.lit(e).alias("engine"), texts[e].alias("rule_text")) for e in ENGINES])
    return named.withColumn("_rule", F.explode(both)).select(
        "sid", F.lit(1).alias("rev"), F.col("_rule.engine").alias("engine"), F.col("_rule.rule_text").alias("rule_text"),
        F.col("_cat").alias("attack_cat"), F.col("_src").alias("target_ip"), F.col("_created").alias("created_at"),
    )


def rate_hits(packets: DataFrame, hits: int, seconds: float, slide: float | None = None) -> DataFrame:
    """Sources with at least ``hits`` packets in a window of ``seconds``."""
    width = int(seconds * 1_000_000)
    start = F.floor(F.col("ts_us") / width) * width
    if slide is None:
        per = packets.groupBy(start.alias("window_us"), "src_ip").agg(F.count(F.lit(1)).alias("hits"))
    else:
        per = sliding_counts(packets, width, int(slide * 1_000_000), ["src_ip"]).withColumnRenamed("n", "hits")
    return per.filter(F.col("hits") >= hits)


def sliding_counts(rows: DataFrame, width_us: int, slide_us: int, keys: list[str]) -> DataFrame:
    """Counts in overlapping windows. Rows are first counted per slide, then those counts are spread."""
    if width_us % slide_us:
        raise ValueError("the window must be a multiple of the slide")
    slide = F.floor(F.col("ts_us") / slide_us)
    per_slide = rows.groupBy(slide.alias("_s"), *keys).agg(F.count(F.lit(1)).alias("_n"))
    first = F.col("_s") - (width_us // slide_us - 1)
    return (
        per_slide.withColumn("_w", F.explode(F.sequence(first, F.col("_s"))))
        .groupBy((F.col("_w") * slide_us).alias("window_us"), *keys)
        .agg(F.sum("_n").alias("n"))
    )


def block_entries(alerts: DataFrame, created_us: Column, ttl_seconds: int = BLOCK_TTL_S, backend: str = "nftables") -> DataFrame:
    """One block entry per source address; a later alert starts its time again."""
    latest = alerts.groupBy(F.col("src_ip").alias("target_ip")).agg(F.max(created_us).alias("created_us"))
    return latest.select(
        "target_ip", F.lit(backend).alias("backend"), F.lit("DROP").alias("action"), "created_us",
        F.lit(ttl_seconds).alias("ttl_seconds"),
        (F.col("created_us") + F.lit(ttl_seconds * 1_000_000)).alias("expires_us"),
    )


def _latest_event(events: DataFrame) -> DataFrame:
    at = F.struct("created_us", "version")
    return events.groupBy("target_ip").agg(F.max_by(F.struct("event", "ttl_seconds", "created_us"), at).alias("e")).select(
        "target_ip", "e.*", (F.col("e.created_us") + F.coalesce("e.ttl_seconds", F.lit(0)) * 1_000_000).alias("expires_us")
    )


def blocks_at(events: DataFrame, at_us: int) -> DataFrame:
    """Blocks in force at a moment: the latest event is a block that has not expired."""
    latest = _latest_event(events.filter(F.col("created_us") <= at_us))
    return latest.filter((F.col("event") == "block") & (F.col("expires_us") > at_us)).drop("event")


def blocks_expired(events: DataFrame, at_us: int) -> DataFrame:
    """Addresses whose block ran out by then and was not lifted."""
    latest = _latest_event(events.filter(F.col("created_us") <= at_us))
    return latest.filter((F.col("event") == "block") & (F.col("expires_us") <= at_us)).drop("event")


def blocked_as_of(rows: DataFrame, events: DataFrame, at: str, row_id: str, ip: str = "src_ip", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark every row with whether its address was blocked at its own time.

    As-of lookup without a join: rows and events of an address are put in time order, and the last
    event is carried to the rows. Busy addresses are cut into pieces.
    """
    events_in = events.select(
        F.col("target_ip").alias("_ip"), F.col("created_us").alias("_at"), F.lit(0).alias("_kind"),
        F.col("version").alias("_id"),
        F.struct("event", (F.col("created_us") + F.coalesce("ttl_seconds", F.lit(0)) * 1_000_000).alias("until")).alias("_e"),
    )
    rows_in = rows.select(
        F.col(ip).alias("_ip"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(row_id).alias("_id"),
        F.struct(*rows.columns).alias("_row"),
    )
    merged = events_in.unionByName(rows_in, allowMissingColumns=True)
    order = ("_at", "_kind", "_id")

    def carried(part: DataFrame, lane: Lane) -> DataFrame:
        known = scan(part, lane, upto={"_last": F.col("_e")}).filter(F.col("_kind") == 1)
        active = (F.col("_last.event") == "block") & (F.col("_last.until") > F.col("_at"))
        return known.select("_row.*", F.coalesce(active, F.lit(False)).alias("blocked"))

    usual, hot, pieces = split_hot(merged, ["_ip"], hot_rows)
    result = carried(usual, Lane(("_ip",), order))
    if hot is None:
        return result
    placed, lane = cut(hot, ["_ip"], order, pieces, "blocked-as-of")
    return result.unionByName(carried(placed.drop(SLOT), lane)).drop(PIECE)


def mitigation_events(alerts: DataFrame, created_us: Column, ttl_seconds: int = BLOCK_TTL_S, backend: str = "nftables") -> DataFrame:
    """The record of each response: alert, block entry and rule ids. Everything follows from the alert."""
    until = created_us + F.lit(ttl_seconds * 1_000_000)
    return alerts.select(
        F.lit("THREAT_MITIGATION_ENACTED").alias("event_type"),
        iso_utc(created_us).alias("timestamp"),
        F.coalesce("src_ip", F.lit("127.0.0.1")).alias("target_ip"),
        F.coalesce("attack_cat", F.lit("Generic")).alias("attack_category"),
        F.struct(
            F.coalesce("src_ip", F.lit("127.0.0.1")).alias("target_ip"),
            F.lit(backend).alias("backend"), F.lit("DROP").alias("action"),
            iso_utc(created_us).alias("created_at"), F.lit(ttl_seconds).alias("ttl_seconds"),
            iso_utc(until).alias("expires_at"), F.lit(True).alias("is_active"),
        ).alias("firewall_rule"),
        F.col("sid").alias("snort3_sid"),
        F.col("sid").alias("suricata_sid"),
        F.struct(*[c for c in alerts.columns if c != "sid"]).alias("alert"),
    )
