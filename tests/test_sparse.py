import pytest
from pyspark.sql import functions as F

from flowtide.operators.cleaning import Preprocessor
from flowtide.operators.sparse import SparsePreprocessor
from flowtide.schemas import NUMERIC
from harness import views as V


def test_sparse_equals_dense(spark, sf):
    train, test = (V.labelled_flows(spark, sf, s) for s in ("train", "test"))
    test = test.withColumn("service", F.when(F.col("id") % 3 == 0, "unheard").otherwise(F.col("service")))
    dense, sparse = Preprocessor.fit(train), SparsePreprocessor.fit(train)
    assert sparse.width == len(dense.names)
    want = {r["id"]: list(r["features"]) for r in dense.transform(test, ["id"]).collect()}
    got = {r["id"]: r["features"] for r in sparse.transform(test, ["id"]).collect()}
    assert got.keys() == want.keys()
    for k, f in got.items():
        assert f["indices"] == sorted(f["indices"]) and 0.0 not in f["values"] and f["size"] == sparse.width
        full = [0.0] * f["size"]
        for i, v in zip(f["indices"], f["values"]):
            full[i] = v
        assert full == pytest.approx(want[k], abs=1e-12)


def test_vocabulary_of_any_size(spark, sf):
    train = V.labelled_flows(spark, sf, "train").withColumn("service", F.concat(F.lit("s"), F.col("id").cast("string")))
    n = train.select("id").distinct().count()
    with pytest.raises(ValueError):
        Preprocessor.fit(train, max_vocabulary=n - 1)
    sparse = SparsePreprocessor.fit(train)
    assert sparse.width > len(NUMERIC) + n
    hot = sparse.cells(train, ["id"]).where(F.col("index") >= len(NUMERIC))
    assert hot.count() == 3 * train.count() and hot.select("index").distinct().count() == sparse.width - len(NUMERIC)
