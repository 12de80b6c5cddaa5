from pyspark.sql import functions as F

from flowtide.plans.detection import find, packet_alerts, respond
from flowtide.plans.fit import TREE, fit_baselines
from flowtide.schemas import EXPECTED_FEATURES
from flowtide.sources.models import load_bundle
from harness import views as V


def test_packets_to_responses(spark, sf):
    out = respond(packet_alerts(V.packets(spark, sf), V.model(), flow_timeout=V.P1[0], active_timeout=V.P1[1]))
    n = out.alerts.count()
    assert n > 0 and out.rules.count() == 2 * n and out.events.count() == n
    assert out.alerts.select("sid").distinct().count() == n
    assert out.blocks.count() == out.alerts.select("src_ip").distinct().count()


def test_fit_store_and_find(spark, sf, tmp_path):
    train, test = V.labelled_flows(spark, sf, "train"), V.labelled_flows(spark, sf, "test")
    fitted = fit_baselines(train, test, str(tmp_path))
    assert set(fitted.metrics) == set(fitted.paths) and fitted.champion in fitted.paths
    assert all(0.0 <= m["roc_auc"] <= 1.0 for m in fitted.metrics.values())
    raw = test.select("id", *[F.col(c).cast("string").alias(c) for c in EXPECTED_FEATURES])
    raw = raw.withColumn("dur", F.when(F.col("spkts") == "2.0", "bad").otherwise(F.col("dur")))
    findings, alerts, quarantine = find(raw, load_bundle(spark, fitted.paths[TREE]), F.lit(1))
    assert findings.count() + quarantine.count() == raw.count() and quarantine.count() > 0
    assert alerts.count() == findings.filter("is_alert").count() > 0
