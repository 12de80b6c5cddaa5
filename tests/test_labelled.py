import pytest
from pyspark.sql import functions as F

from flowtide.operators import cleaning as cl
from flowtide.operators import evaluation as ev
from flowtide.operators import profiling as pr
from flowtide.operators import training
from flowtide.schemas import CATEGORICAL, EXPECTED_FEATURES, LABELLED_FLOW, NUMERIC
from flowtide.sources import models as model_io
from flowtide.sources import tables
from harness import views as V


def labelled(spark, protos, services, states, numbers, cats=None, labels=None):
    n = len(protos)
    cats, labels = cats or ["Normal"] * n, labels or [0] * n
    rows = [
        (i, protos[i], services[i], states[i], *[float(numbers[i])] * len(NUMERIC), cats[i], labels[i]) for i in range(n)
    ]
    return spark.createDataFrame(rows, LABELLED_FLOW)


def test_cleaning_golden(spark):
    rows = labelled(spark, ["tcp", " udp", "tcp"], ["http", "-", "dns "], ["FIN", "", "\tINT\n"], [10, 20, 30])
    got = cl.clean_categoricals(rows).orderBy("id").collect()
    assert [r["service"] for r in got] == ["http", "none", "dns"]
    assert [r["state"] for r in got] == ["FIN", "unknown", "INT"]
    assert [r["proto"] for r in got] == ["tcp", "udp", "tcp"]


def test_features_leave_out_id_and_targets(spark):
    rows = labelled(spark, ["tcp"], ["http"], ["FIN"], [1], [" DoS "], [1]).withColumn("extra", F.lit(1))
    features, targets = cl.features_and_labels(rows)
    assert features.columns == EXPECTED_FEATURES
    assert targets.first()["attack_cat"] == "DoS"


def test_missing_feature_is_named(spark):
    rows = labelled(spark, ["tcp"], ["http"], ["FIN"], [1]).drop("sbytes")
    with pytest.raises(ValueError, match="sbytes"):
        cl.contract_check(rows)


def test_scaling_and_unseen_categories(spark):
    train = labelled(spark, ["tcp", "udp"], ["http", "dns"], ["FIN", "CON"], [0, 10])
    test = labelled(spark, ["tcp", "newproto"], ["http", "dns"], ["ACC", "CLO"], [100, 5])
    prep = cl.Preprocessor.fit(train)
    assert set(prep.means) == {5.0} and set(prep.stds) == {5.0}
    got = prep.transform(test, ["id"]).orderBy("id").collect()
    assert all(len(r["features"]) == len(prep.names) == 39 + 6 for r in got)
    assert got[0]["features"][:39] == [19.0] * 39
    at = {n: i for i, n in enumerate(prep.names)}
    assert got[0]["features"][at["proto_tcp"]] == 1.0
    assert sum(got[1]["features"][39:]) == 1.0  # only the known service


def test_constant_column_scales_by_one(spark):
    prep = cl.Preprocessor.fit(labelled(spark, ["tcp", "tcp"], ["-", "-"], ["FIN", "FIN"], [7, 7]))
    assert set(prep.stds) == {1.0}


def test_validation_splits_rows(spark):
    rows = labelled(spark, ["tcp", "tcp"], ["http", "http"], ["FIN", "FIN"], [1, 2])
    raw = rows.select("id", *[F.col(c).cast("string").alias(c) for c in EXPECTED_FEATURES if c != "dur"],
                      F.when(F.col("id") == 0, "0.5").otherwise("quick").alias("dur"))
    valid, quarantine = cl.split_valid(raw)
    assert [r["id"] for r in valid.collect()] == [0]
    assert quarantine.first()["reasons"] == ["dur: invalid"]


def test_csv_round_trip_keeps_blanks_and_nulls(spark, sf, tmp_path):
    rows = V.labelled_flows(spark, sf).withColumn("service", F.when(F.col("spkts") > 2, F.col("service")))
    tables.write_labelled_flows(rows.select(*LABELLED_FLOW.names), str(tmp_path / "csv"))
    back = tables.scan_labelled_flows(spark, str(tmp_path / "csv"))
    assert all(r[tables.CORRUPT] is None for r in back.collect())
    back = back.drop(tables.CORRUPT)
    assert back.exceptAll(rows.select(*back.columns)).count() == 0 and back.count() == rows.count()


def test_models_train_and_round_trip(spark, sf):
    train, test = V.labelled_flows(spark, sf, "train"), V.labelled_flows(spark, sf, "test")
    prep = cl.Preprocessor.fit(train)
    tree = training.train_tree(prep.vectors(train, ["label"]))
    path = model_io.save_bundle(spark, prep, tree, "DecisionTreeClassifier", {"note": "test"})
    loaded = model_io.load_bundle(spark, path)
    from pyspark.ml.functions import vector_to_array

    def metrics(p, m):
        scored = m.transform(p.vectors(test, ["label"])).withColumn("p", vector_to_array("probability")[1])
        return ev.binary_metrics(scored).first()

    a, b = metrics(prep, tree), metrics(loaded.preprocessor, loaded.model)
    assert a == b and loaded.metadata == {"note": "test"}
    assert a["tn"] + a["fp"] + a["fn"] + a["tp"] == test.count()
    assert 0.5 < a["accuracy"] <= 1.0


def test_auc_matches_pair_count(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.35, 1), (0.8, 1), (0.4, 0)]
    got = ev.roc_auc(spark.createDataFrame(rows, "p double, label int")).first()["roc_auc"]
    pos = [p for p, y in rows if y]
    neg = [p for p, y in rows if not y]
    assert got == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_zero_division_gives_zero(spark):
    got = ev.binary_metrics(spark.createDataFrame([(0.1, 0)], "p double, label int")).first()
    assert (got["precision"], got["recall"], got["f1_score"], got["false_negative_rate"]) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("limit", [10**6, 20, 1])
def test_exact_median_by_narrowing(spark, limit):
    rows = spark.range(0, 1001).select(
        F.pmod(F.col("id") * 7919, F.lit(1000)).cast("double").alias("a"), F.lit(3.0).alias("b"),
        F.when(F.col("id") % 2 == 0, F.col("id") * 1.5).alias("c"), F.lit(None).cast("double").alias("d"),
    )
    got = {r["column"]: r["median"] for r in pr.exact_medians(rows, ["a", "b", "c", "d"], limit).collect()}
    pdf = rows.toPandas()
    assert got == {c: pytest.approx(pdf[c].median()) for c in "abc"}


def test_constant_and_quasi_constant_columns(spark):
    rows = spark.range(0, 1000).select(
        F.lit("x").alias("same"), F.when(F.col("id") == 5, 1).otherwise(0).alias("nearly"),
        F.when(F.col("id") < 2, F.lit("v")).alias("mostly_null"), F.col("id").alias("id"),
    )
    got = {r["column"]: (r["kind"], r["top_value"]) for r in pr.constant_columns(rows).collect()}
    assert got == {"same": ("constant", "x"), "nearly": ("quasi_constant", "0"), "mostly_null": ("quasi_constant", None)}


def test_label_alignment_finds_a_wrong_label(spark):
    good = labelled(spark, ["tcp"] * 2, ["-"] * 2, ["FIN"] * 2, [1, 2], ["Normal", "DoS"], [0, 1])
    bad = labelled(spark, ["tcp"] * 2, ["-"] * 2, ["FIN"] * 2, [1, 2], ["Normal", "DoS"], [0, 0])
    assert pr.label_alignment(good).first()[0] and not pr.label_alignment(bad).first()[0]


def test_unseen_values_per_side(spark):
    train = labelled(spark, ["tcp", "udp"], ["-"] * 2, ["FIN"] * 2, [1, 2])
    test = labelled(spark, ["tcp", "arp"], ["-"] * 2, ["FIN"] * 2, [1, 2])
    got = {(r["column"], r["value"], r["only_in"]) for r in pr.unseen_categories(train, test, CATEGORICAL).collect()}
    assert got == {("proto", "udp", "train"), ("proto", "arp", "test")}
