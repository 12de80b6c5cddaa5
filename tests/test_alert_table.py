"""The bucketed alert table: one bucket a look-up, repeated and failed batches, counts with retraction."""

import random

import pytest

from flowtide.operators.alerts import alert_statistics, latest_versions, list_alerts
from flowtide.streaming.alert_table import AlertTable

SCHEMA = "finding_id string, version long, status string, severity string"


def made(spark, seed, n, ids=40):
    rnd = random.Random(seed)
    rows = [(f"id{rnd.randrange(ids)}", rnd.randrange(10**9), rnd.choice(["New", "Investigating", "Resolved", None]),
             rnd.choice(["LOW", "HIGH", "CRITICAL"])) for _ in range(n)]
    return spark.createDataFrame([*rows, (None, 1, "New", "LOW")], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.select("finding_id", "version", "status", "severity").collect()))


def test_batches(spark, tmp_path):
    table = AlertTable(spark, str(tmp_path), buckets=4)
    assert table.current() is None and table.lookup("id1") is None and table.last_batch() == -1
    seen = None
    for batch in range(3):
        new = made(spark, batch, 60)
        seen = new if seen is None else seen.union(new)
        table.apply(new, batch)
        table.apply(made(spark, 99, 5), batch)  # a batch that comes again
        known = seen.where("finding_id is not null").fillna("New", ["status"])
        want = latest_versions(known)
        assert rows_of(table.current()) == rows_of(want)
        assert table.statistics().collect() == alert_statistics(want).collect()
    assert table.statistics(0).first()["total_alerts"] < table.statistics(2).first()["total_alerts"] + 1
    one = table.lookup("id7")
    assert rows_of(one) == [r for r in rows_of(table.current()) if r[0] == "id7"]
    assert len({f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    table.apply(made(spark, 1, 0), 3)
    assert table.last_batch() == 3 and rows_of(table.current()) == rows_of(want)


def test_a_failed_batch_is_not_seen(spark, tmp_path, monkeypatch):
    table = AlertTable(spark, str(tmp_path), buckets=4)
    first, second = made(spark, 1, 50), made(spark, 2, 50)
    table.apply(first, 0)
    before, counts = rows_of(table.current()), table.statistics().collect()

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_count", fails)
        with pytest.raises(RuntimeError):
            table.apply(second, 1)
    assert rows_of(table.current()) == before and table.statistics().collect() == counts
    table.apply(second, 1)
    both = first.union(second).where("finding_id is not null").fillna("New", ["status"])
    assert rows_of(table.current()) == rows_of(latest_versions(both))


def test_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    for seed in range(2):
        made(spark, seed, 30).coalesce(1).write.mode("append").parquet(path)
    table = AlertTable(spark, str(tmp_path / "table"), buckets=3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    table.start(stream).awaitTermination()
    both = made(spark, 0, 30).union(made(spark, 1, 30)).where("finding_id is not null").fillna("New", ["status"])
    assert rows_of(table.current()) == rows_of(latest_versions(both)) and table.last_batch() == 1


@pytest.mark.parametrize("limit", [0, -1, 501])
def test_pages_have_a_bound(spark, limit):
    with pytest.raises(ValueError):
        list_alerts(made(spark, 1, 5), limit=limit)
