import pytest

import __spark_entry__ as entry
from harness import check, registry

LIGHT = [
    "packet_normalise", "flow_volume", "context_counts", "threat_alert", "ids_rules", "alert_update", "blocks_asof_packets",
    "latency_histogram", "windowed_rate", "category_profile", "numeric_summary", "roc_auc",
    "counter_rate", "counter_quantile", "latency_sketch_ranks", "unseen_category_counts", "blocks_expired_stream", "train_tree",
    "pipeline_bundle_io",
]


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.sql())
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", LIGHT)
def test_query_agrees_with_sql(spark, sf, name):
    verdict, rows = check.compare(spark, check.connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf)
    assert verdict == "" and rows > 0
