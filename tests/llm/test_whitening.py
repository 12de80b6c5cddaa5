"""Whitening against a plain computation with Python's integers."""

import math
import random

import numpy as np
import pytest
from flowtide.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, made_ string, n string"


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain(vectors, components=32):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    total = [sum(r[d] for r in x) for d in range(dims)]
    apart = [[n * r[d] - total[d] for d in range(dims)] for r in x]
    deviation = [sum(v * v for v in r) for r in apart]
    centred = np.array([[v / n for v in r] for r in apart])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return n, deviation, centred, cov, values[order], vectors[:, order]


def rows_of(spark, rows, components=32):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=components).collect()
    return {(r["vec_id"], r["component"]): r for r in found}


@pytest.mark.parametrize("big", [False, True])
def test_whitening(spark, big, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 100)
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    vectors = (rng.normal(size=(300, 6)) @ mix * (1e9 if big else 0.3)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 5
    odd = [None, [], [0.1] * 5, [0.1] * 5 + [None], [0.1] * 5 + [float("nan")], [float("inf")] + [0.0] * 5, [1e38] * 6]
    rows = [(k, v, None, "x", "y") for k, v in enumerate([*vectors, *odd])]
    got = rows_of(spark, rows, components=4)
    n, deviation, centred, cov, values, directions = plain(vectors, 4)
    assert {k for k, _ in got} == set(range(len(vectors))) and len(got) == 4 * n
    white = np.array([[got[k, c + 1]["whitened"] for c in range(4)] for k in range(n)])
    want = centred @ directions / np.sqrt(values)
    assert np.allclose(np.abs(white), np.abs(want), rtol=1e-6, atol=1e-7)
    assert np.abs(white.T @ white / n - np.eye(4)).max() < 1e-9
    for k in range(n):
        r = got[k, 1]
        assert r["n"] == n and int(r["deviation"]) == deviation[k] and r["identity_error"] < 1e-9 and r["made_"] == "x"
    assert [got[0, c + 1]["explained"] for c in range(4)] == pytest.approx((values / np.trace(cov)).tolist(), rel=1e-9)


@pytest.mark.parametrize("high", [1, 2**9, 2**41])
def test_cross_products_are_exact(high):
    rnd = random.Random(high)
    block = [[rnd.randrange(high + 1) for _ in range(4)] + [0] for _ in range(130)]
    got = whitening.cross_products(np.array(block, np.int64))
    for i in range(5):
        for j in range(i, 5):
            assert got[i][j] == sum(r[i] * r[j] for r in block)


def test_without_variance(spark):
    flat = rows_of(spark, [(k, [0.5, float(k % 2)], 1, "", "") for k in range(4)])
    assert len(flat) == 8 and {r["whitened"] for (_, c), r in flat.items() if c == 2} == {0.0}
    assert {r["explained"] for (_, c), r in flat.items() if c == 1} == {1.0} and flat[0, 1]["identity_error"] < 1e-9
    one = rows_of(spark, [(7, [0.5, 0.25], 1, "", "")])
    assert {(r["whitened"], r["explained"], int(r["deviation"])) for r in one.values()} == {(0.0, 0.0, 0)}
    assert rows_of(spark, []) == {} and rows_of(spark, [(1, None, 1, "", "")]) == {}


def test_most_common_length(spark):
    rows = [(k, [float(k)] * (2 if k < 3 else 3), 1, "", "") for k in range(6)]
    assert {k for k, _ in rows_of(spark, rows)} == {3, 4, 5}


def test_query_on_its_table(spark, sf):
    from flowtide.llm.q_whitening import op13_whitening

    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    n, deviation, _, _, _, _ = plain(table["embedding"].tolist())
    got = op13_whitening(spark, sf).toPandas()
    assert len(got) == 32 * n and got["identity_error"].max() < 1e-4 and got["n"].eq(n).all()
    first = got[got.component == 1].set_index("vec_id")["deviation"].to_dict()
    assert first == dict(zip(table["vec_id"], deviation))
