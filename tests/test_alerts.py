import pytest
from pyspark.sql import functions as F

from flowtide.operators import alerts as al
from flowtide.operators import response as rs
from flowtide.operators import scoring as sc
from flowtide.operators import telemetry as tm
from flowtide.schemas import ALERT
from flowtide.sources import tables
from harness import views as V


def alert_rows(spark, *rows):
    base = dict(
        finding_id="a", timestamp="2024-01-01T00:00:00+00:00", prediction=1, label="Attack", probability_attack=0.885,
        confidence=0.885, is_alert=True, severity="HIGH", model_name="m", threshold_used=0.5,
        features_summary_json='{"proto": "tcp", "sbytes": 5}', status="New", analyst_notes="", updated_at="t", version=1,
    )
    return spark.createDataFrame([tuple((base | r)[n] for n in ALERT.names) for r in rows], ALERT)


def test_upsert_replaces_the_whole_row(spark):
    stored = alert_rows(spark, {"status": "Resolved", "analyst_notes": "done"}, {"finding_id": "b"})
    got = {r["finding_id"]: r for r in al.upsert(stored, alert_rows(spark, {"version": 2, "status": None})).collect()}
    assert got["a"]["status"] == "New" and got["a"]["analyst_notes"] == "" and len(got) == 2


def test_update_sets_only_what_is_given(spark):
    stored = alert_rows(spark, {}, {"finding_id": "b", "analyst_notes": "old"})
    updates = spark.createDataFrame(
        [("a", 2, "Investigating", None, "t2"), ("b", 2, None, "new", "t3"), ("zzz", 2, "Resolved", None, "t4")],
        "finding_id string, version long, status string, analyst_notes string, updated_at string",
    )
    got = {r["finding_id"]: r for r in al.update_alerts(stored, updates).collect()}
    assert (got["a"]["status"], got["a"]["analyst_notes"], got["a"]["updated_at"]) == ("Investigating", "", "t2")
    assert (got["b"]["status"], got["b"]["analyst_notes"]) == ("New", "new") and set(got) == {"a", "b"}


def test_list_filters_pages_and_orders(spark):
    stored = alert_rows(spark, *[{"finding_id": str(i), "timestamp": f"2024-01-0{i}", "severity": "HIGH" if i % 2 else "LOW"} for i in range(1, 8)])
    assert [r["finding_id"] for r in al.list_alerts(stored, severity="HIGH", limit=2, offset=1).collect()] == ["5", "3"]


def test_statistics_count_absent_statuses(spark):
    got = al.alert_statistics(alert_rows(spark, {})).first()
    assert tuple(got) == (1, 1, 0, 0, 1)


def test_csv_export_columns(spark, tmp_path):
    tables.export_alerts_csv(alert_rows(spark, {}), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == tables.ALERT_CSV_COLUMNS and back.first()["finding_id"] == "a"


def test_broken_evidence_reads_as_empty(spark):
    got = tables.parse_evidence(alert_rows(spark, {"features_summary_json": "{nope"}, {"finding_id": "b"})).collect()
    assert {r["finding_id"]: r["features_summary"]["proto"] for r in got} == {"a": None, "b": "tcp"}


@pytest.mark.parametrize("threshold,expected", [(0.0, 3), (0.5, 2), (1.0, 1)])
def test_threshold_is_inclusive(spark, threshold, expected):
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    found = al.security_findings(rows, threshold)
    assert found.filter("is_alert").count() == expected
    assert found.select("timestamp").distinct().count() == 1


def test_findings_without_probability(spark):
    rows = spark.createDataFrame([(1, "tcp"), (0, "udp")], "prediction int, proto string")
    got = {r["prediction"]: r for r in al.security_findings(rows, prob=None).collect()}
    assert got[1]["severity"] == "CRITICAL" and got[1]["confidence"] == 1.0 and got[1]["probability_attack"] is None
    assert got[0]["severity"] == "INFORMATIONAL" and got[0]["features_summary"]["proto"] == "udp"


def test_severity_tiers(spark):
    rows = spark.createDataFrame([(p,) for p in (0.5, 0.6, 0.75, 0.9)], "p double")
    got = [r[0] for r in rows.select(al.severity_tier(F.col("p") >= 0.5, F.col("p"))).collect()]
    assert got == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def one_alert(spark):
    return spark.createDataFrame(
        [("172.16.0.99", "10.0.0.1", 55123, 80, "tcp", "DoS", 0.99, "syn_ratio", 1000001)],
        "src_ip string, dst_ip string, src_port int, dst_port int, proto string, attack_cat string, anomaly_prob double, "
        "primary_contributing_feature string, sid long",
    )


def test_rule_texts(spark):
    got = {r["engine"]: r["rule_text"] for r in rs.ids_rules(one_alert(spark), F.lit("2024-01-01 00:00:00 UTC"), tag="t").collect()}
    assert got["snort3"] == (
        'alert tcp 172.16.0.99 55123 -> 10.0.0.1 80 ( msg:"[t] DoS Attack Detected (Root-Cause: syn_ratio)"; '
        "classtype:denial-of-service; sid:1000001; rev:1; metadata:created_at 2024-01-01 00:00:00 UTC, confidence 0.99, "
        "engine t_v1; threshold:type both, track by_src, count 50, seconds 5; )"
    )
    assert got["suricata"] == (
        'alert tcp 172.16.0.99 55123 -> 10.0.0.1 80 ( msg:"[t] DoS Anomaly (Attr: syn_ratio)"; flow:to_server; '
        "classtype:denial-of-service; sid:1000001; rev:1; threshold:type threshold, track by_src, count 50, seconds 5; )"
    )


def test_unknown_protocol_and_category(spark):
    row = one_alert(spark).withColumns({"proto": F.lit("proto-47"), "attack_cat": F.lit("Worms")})
    text = rs.ids_rules(row, F.lit("t")).filter("engine = 'snort3'").first()["rule_text"]
    assert text.startswith("alert ip ") and "classtype:bad-traffic" in text and "threshold" not in text


def test_sids_go_on_after_the_highest(spark, tmp_path):
    path = str(tmp_path / "rules")
    alerts = spark.range(0, 5).select(F.col("id"), F.lit("a").alias("src_ip"))
    assert sorted(r["sid"] for r in rs.assign_sids(alerts, ["id"]).collect()) == list(range(1000001, 1000006))
    tables.append_rules(rs.ids_rules(one_alert(spark), F.lit("t")), path)
    top = tables.highest_sid(tables.load_rules(spark, path))
    assert min(r["sid"] for r in rs.assign_sids(alerts, ["id"], highest=top).collect()) == 1000002


def events(spark, *rows):
    return spark.createDataFrame(rows, "version long, created_us long, target_ip string, event string, ttl_seconds long")


def test_block_expires_at_its_end(spark):
    e = events(spark, (1, 0, "198.51.100.42", "block", 1))
    assert rs.blocks_at(e, 999_999).count() == 1 and rs.blocks_expired(e, 999_999).count() == 0
    assert rs.blocks_at(e, 1_000_000).count() == 0 and rs.blocks_expired(e, 1_000_000).count() == 1


def test_new_block_restarts_and_unblock_ends(spark):
    e = events(spark, (1, 0, "a", "block", 10), (2, 5_000_000, "a", "block", 10), (3, 0, "b", "block", 10), (4, 1, "b", "unblock", None))
    assert [r["target_ip"] for r in rs.blocks_at(e, 12_000_000).collect()] == ["a"]


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_blocked_as_of_matches_brute_force(spark, sf, hot_rows):
    packets, e = V.packets(spark, sf).select("pkt_id", "ts_us", "src_ip"), V.block_events(spark, sf)
    log = sorted((r["created_us"], r["version"], r["target_ip"], r["event"], r["ttl_seconds"]) for r in e.collect())
    got = {r["pkt_id"]: r for r in rs.blocked_as_of(packets, e, "ts_us", "pkt_id", hot_rows=hot_rows).collect()}
    assert len(got) == packets.count()
    for r in got.values():
        last = next((x for x in reversed(log) if x[2] == r["src_ip"] and x[0] <= r["ts_us"]), None)
        assert r["blocked"] == bool(last and last[3] == "block" and last[0] + last[4] * 1_000_000 > r["ts_us"])


def walk(tree, row):
    """Leaf and path steps of one row."""
    node, steps = tree[0], {}
    while node["probs"] is None:
        right = row[node["feature"]] > node["threshold"]
        steps[node["feature"]] = steps.get(node["feature"], 0.0) + (0.15 if right else -0.05)
        node = tree[node["right" if right else "left"]]
    return node["probs"], steps


def test_scores_and_attributions_match_a_walk(spark, sf):
    model = V.model()
    got = sc.attribute(sc.score(V.records(spark, sf), model), model).collect()
    assert got
    for r in got:
        parts = [walk(t, r) for t in model.trees]
        mean = [sum(p[i] for p, _ in parts) / 3 for i in range(6)]
        assert r["probs"] == pytest.approx(mean) and r["anomaly_prob"] == pytest.approx(1 - mean[0])
        assert r["predicted"] == model.classes[mean.index(max(mean))]
        total = {}
        for _, steps in parts:
            for f, v in steps.items():
                total[f] = total.get(f, 0.0) + v / 3
        size = sorted((round(abs(v), 9) for v in total.values()), reverse=True)[:3]
        shown = [round(abs(c["value"]), 9) for c in r["contributors"]]
        assert shown[: len(size)] == size
        assert all(c["value"] == pytest.approx(total.get(c["feature"], 0.0)) for c in r["contributors"])


def test_histogram_is_cumulative(spark):
    rows = spark.createDataFrame([(0.00015,), (0.003,), (7.0,)], "seconds double")
    got = {r["le"]: r["bucket"] for r in tm.latency_histogram(rows).collect()}
    assert got["0.000100"] == 0 and got["0.000250"] == 1 and got["0.005000"] == 2 and got["0.100000"] == 2 and got["+Inf"] == 3


def test_bucket_quantile_interpolates(spark):
    rows = spark.createDataFrame([(0, 0.0015)] * 10 + [(60_000_000, 5.0)], "ts_us long, seconds double")
    got = {r["window_us"]: r["p50"] for r in tm.bucket_quantile(rows, {"p50": 0.5}).collect()}
    assert got == {0: pytest.approx(0.0015), 60_000_000: pytest.approx(0.1)}


def test_empty_latencies_give_zero(spark):
    rows = spark.createDataFrame([], "ts_us long, seconds double")
    assert tuple(tm.latency_percentiles(rows, ["ts_us"]).first()) == (0.0, 0.0, 0.0, 0.0)


def test_telemetry_defaults(spark):
    row = spark.createDataFrame([('{"src_ip": "1.2.3.4", "spkts": 3}',)], "value string")
    got = tables.decode_telemetry(row).first()
    assert (got["src_ip"], got["dst_ip"], got["proto"], got["spkts"], got["rate"], got["dst_port"]) == ("1.2.3.4", "0.0.0.0", "tcp", 3, 0.0, 0)
    keys = tables.encode_telemetry(spark.createDataFrame([("",), ("x",)], "src_ip string")).collect()
    assert [k["key"] for k in keys] == [None, "x"]
