"""Logistic fits by Newton steps: the optimum that Spark ML finds, without keeping the rows in memory."""

from __future__ import annotations

import random

import numpy as np
import pytest
from flowtide.operators import training
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Vectors


def table(spark, rows):
    return spark.createDataFrame([(Vectors.dense(x), y) for x, y in rows], ["features", "label"])


def drawn(n, seed=3):
    rnd = random.Random(seed)
    for _ in range(n):
        x = [rnd.gauss(0, 1), rnd.gauss(2, 3), float(rnd.random() < 0.3), 0.0]
        yield x, int(rnd.random() < 1 / (1 + np.exp(1.5 - x[0] - 0.4 * x[1] + 2 * x[2])))


@pytest.fixture
def no_gradient_fit(monkeypatch):
    def fit(self, *a):
        raise AssertionError("a fit that keeps all rows and reads them in each of many small steps")

    real = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", fit)
    return real


def test_newton_finds_the_same_optimum(spark, no_gradient_fit, tmp_path):
    rows = table(spark, drawn(3000)).repartition(5).cache()
    conf = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    plain, weighted = training.train_logistics(rows, [False, True], c=0.5)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == conf
    for model, data in ((plain, rows), (weighted, training.class_weights(rows))):
        fit = LogisticRegression(regParam=1 / (0.5 * 3000), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12)
        want = no_gradient_fit(fit.setWeightCol("weight") if data is not rows else fit, data)
        assert np.allclose(model.coefficients, want.coefficients, atol=1e-3) and abs(model.intercept - want.intercept) < 1e-3
        assert model.coefficients[3] == 0
    assert abs(plain.intercept - weighted.intercept) > 0.01
    one = training.train_logistic(rows, c=0.5, balanced=True)
    assert np.allclose(one.coefficients, weighted.coefficients, atol=1e-6) and one.getWeightCol() == "weight"
    plain.write().save(str(tmp_path / "model"))
    loaded = LogisticRegressionModel.load(str(tmp_path / "model"))
    assert loaded.transform(rows).select("probability").collect() == plain.transform(rows).select("probability").collect()


def test_separable_rows_and_large_numbers(spark, no_gradient_fit):
    rows = table(spark, [([k * 1e4, 1.0], int(k > 20)) for k in range(40)])
    model = training.train_logistic(rows, c=1e6)
    assert [r.prediction for r in model.transform(rows).collect()] == [float(k > 20) for k in range(40)]


def test_blocks_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 28)
    rows = table(spark, drawn(101)).repartition(3)
    found = [(np.frombuffer(b.x).reshape(4, -1), np.frombuffer(b.y)) for b in training._blocks(rows, "label").collect()]
    got = sorted((*x[:, k], y[k]) for x, y in found for k in range(len(y)))
    assert got == sorted((*r.features, r.label) for r in rows.collect()) and max(len(y) for _, y in found) == 7
    at = np.array([[0.1, -0.2, 0.3, 0.0, 0.05]])
    sums = training._sums(training._blocks(rows, "label"), at, [(1.0, 2.0)])[0]
    x, y = (np.concatenate([f[k] for f in found], axis=-1) for k in (0, 1))
    p, w = 1 / (1 + np.exp(-(at[0, :4] @ x + 0.05))), 1 + y
    assert np.allclose(sums[0], -(w * np.log(np.where(y == 1, p, 1 - p))).sum()) and np.allclose(sums[1:6], [*(x @ (w * (p - y))), (w * (p - y)).sum()])


def test_other_tables_go_to_spark_ml(spark, monkeypatch):
    one_class = table(spark, [([1.0, 2.0], 1), ([2.0, 1.0], 1)])
    assert training.train_logistic(one_class).transform(one_class).where("prediction = 1").count() == 2
    monkeypatch.setattr(training, "NEWTON_FEATURES", 3)
    monkeypatch.setattr(training, "_newton", None)
    assert training.train_logistic(table(spark, drawn(60))).numFeatures == 4
