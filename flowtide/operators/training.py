"""Model fits on Spark ML and their export to node tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.schemas import ATTACK_CLASSES, ENSEMBLE_NODE, TARGET
from flowtide.session import discard, materialise

# Up to so many features a logistic fit takes Newton steps, whose sums of squares go to the driver; wider ones go by gradients alone.
NEWTON_FEATURES = 256
# Numbers of a block of rows, and blocks that a worker gets at once. A page of a Parquet file may hold a hundred of them.
BLOCK, BLOCKS_AT_ONCE = 8192, 64
# A fit ends where a step would lower its loss by no more than this share.
TOLERANCE = 1e-6
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def class_weights(rows: DataFrame, label: str = TARGET) -> DataFrame:
    """Add weights that balance the two classes."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    pos, neg = max(n["pos"], 1), max(n["n"] - n["pos"], 1)
    return rows.withColumn(
        "weight", F.when(F.col(label) == 1, n["n"] / (2.0 * pos)).otherwise(n["n"] / (2.0 * neg))
    )


def train_logistic(rows: DataFrame, c: float = 1.0, max_iter: int = 1000, balanced: bool = False, label: str = TARGET):
    """L2 logistic regression; the penalty is on the mean loss, hence 1 / (C n)."""
    return train_logistics(rows, [balanced], c, max_iter, label)[0]


def train_logistics(
    rows: DataFrame, balanced: Sequence[bool] = (False, True), c: float = 1.0, max_iter: int = 1000, label: str = TARGET
) -> list[LogisticRegressionModel]:
    """One L2 logistic regression for each of ``balanced``, as train_logistic gives it; all are fitted in the same passes.

    Newton steps reach the optimum in some ten passes, and rows are packed once into blocks on disk, so nothing of their number is kept
    in memory. Tables with more than NEWTON_FEATURES features or without two classes 0 and 1 are left to Spark ML.
    """
    is_ = lambda v: F.count_if(F.col(label) == v)
    n, pos, neg = rows.agg(F.count(F.lit(1)), is_(1), is_(0)).first()
    first = rows.select("features").first() if pos and neg and n == pos + neg else None
    fits = [
        LogisticRegression(
            labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter,
            **({"weightCol": "weight"} if b else {}),
        )
        for b in balanced
    ]
    if first is None or first[0] is None or first[0].size > NEWTON_FEATURES:
        return [fit.fit(class_weights(rows, label) if b else rows) for fit, b in zip(fits, balanced)]
    weights = [(n / (2.0 * neg), n / (2.0 * pos)) if b else (1.0, 1.0) for b in balanced]
    blocks = materialise(_blocks(rows, label), "blocks")
    found = _newton(blocks, first[0].size, n, weights, 1.0 / (c * n), max_iter)
    discard(blocks)
    return [_logistic_model(rows.sparkSession, fit, b) for fit, b in zip(fits, found)]


def _blocks(rows: DataFrame, label: str) -> DataFrame:
    """(x, y): features and labels of some rows each, a feature after the other, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(y):
                continue
            if len(x) % len(y) or not np.isfinite(x).all():
                raise ValueError("features must be finite and of one length")
            x = x.reshape(len(y), -1)
            size = max(1, BLOCK // max(x.shape[1], 1))
            cuts = range(0, len(y), size)
            parts = [[np.ascontiguousarray(x[k : k + size].T).tobytes() for k in cuts], [y[k : k + size].tobytes() for k in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in parts], names=["x", "y"])

    return rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(run, "x binary, y binary")


def _sums(blocks: DataFrame, at: np.ndarray, weights: Sequence[tuple[float, float]]) -> np.ndarray:
    """For each fit at its point (intercept last): the loss, its gradient and its second derivatives, summed over all rows, in a row."""
    size = at.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(at), 1 + size + size * size))
        for batch in batches:
            if not len(batch):
                continue
            labels = [np.frombuffer(v.as_buffer()) for v in batch.column("y")]
            parts = [np.frombuffer(v.as_buffer()).reshape(-1, len(y)) for v, y in zip(batch.column("x"), labels)]
            y = np.concatenate(labels)
            x = np.concatenate([np.concatenate(parts, axis=1), np.ones((1, len(y)))])
            for total, b, (zero, one) in zip(out, at, weights):
                w, z = np.where(y == 1, one, zero), b @ x
                p = 0.5 * (1 + np.tanh(0.5 * z))
                total[0] += w @ (np.logaddexp(0, z) - y * z)
                total[1 : 1 + size] += x @ (w * (p - y))
                bent = x * np.sqrt(w * p * (1 - p))
                total[1 + size :] += (bent @ bent.T).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    spark = blocks.sparkSession
    some, before = blocks.coalesce(4 * spark.sparkContext.defaultParallelism), {name: spark.conf.get(name) for name in _BATCHES}
    try:
        for name in _BATCHES:
            spark.conf.set(name, str(BLOCKS_AT_ONCE))
        parts = some.mapInArrow(run, "sums binary").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return sum(np.frombuffer(p[0]).reshape(len(at), -1) for p in parts)


def _newton(blocks: DataFrame, features: int, n: int, weights: Sequence[tuple[float, float]], penalty: float, max_iter: int) -> np.ndarray:
    """Where the weighted mean loss and ``penalty`` / 2 times the squared coefficients are least: a row for each fit, the intercept last.

    A step that does not lower the loss as it should is halved until it does.
    """
    size = features + 1
    ridge = np.concatenate([np.full(features, penalty), [0.0]])
    best, step, slope = np.zeros((len(weights), size)), np.zeros((len(weights), size)), np.zeros(len(weights))
    loss, open_ = np.full(len(weights), np.inf), list(range(len(weights)))
    for _ in range(max_iter + 1):
        at = best + step
        sums = _sums(blocks, at[open_], [weights[k] for k in open_])
        for k, row in zip(list(open_), sums):
            # The weights of both kinds add up to the number of rows.
            now = row[0] / n + 0.5 * ridge @ at[k] ** 2
            if not now <= loss[k] + 1e-4 * slope[k]:
                step[k], slope[k] = step[k] / 2, slope[k] / 2
                if -slope[k] <= 1e-15 * loss[k]:
                    open_.remove(k)
                continue
            best[k], loss[k] = at[k], now
            g = row[1 : 1 + size] / n + ridge * best[k]
            h = row[1 + size :].reshape(size, size) / n + np.diag(ridge)
            scale = 1 / np.sqrt(np.maximum(np.diag(h), 1e-300))
            step[k] = -scale * np.linalg.lstsq(h * np.outer(scale, scale), scale * g, rcond=1e-14)[0]
            slope[k] = g @ step[k]
            if -slope[k] / 2 <= TOLERANCE * loss[k]:
                open_.remove(k)
        if not open_:
            break
    return best


def _logistic_model(spark: SparkSession, fit: LogisticRegression, found: np.ndarray) -> LogisticRegressionModel:
    """The model that ``fit`` would give, with these coefficients and the intercept at the end."""
    jvm = spark.sparkContext._jvm
    values = spark.sparkContext._gateway.new_array(jvm.double, len(found) - 1)
    for k, v in enumerate(found[:-1]):
        values[k] = float(v)
    parent = fit._to_java()
    model = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(fit.uid, jvm.org.apache.spark.ml.linalg.Vectors.dense(values), float(found[-1]))
    model = parent.copyValues(model.setParent(parent), jvm.org.apache.spark.ml.param.ParamMap.empty())
    return LogisticRegressionModel._from_java(model)


def train_tree(rows: DataFrame, max_depth: int = 10, min_leaf: int = 10, label: str = TARGET, seed: int = 42):
    """Depth-limited tree. Ten rows per leaf imply twenty per split."""
    return DecisionTreeClassifier(
        labelCol=label, maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed
    ).fit(rows)


def train_ensemble(
    rows: DataFrame, label: str = "class_index", trees: int = 15, max_depth: int = 5, min_split: int = 10,
    features_per_split: int = 9, seed: int = 42,
) -> RandomForestClassificationModel:
    """Bootstrap trees on random features."""
    return RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=max_depth, impurity="gini", seed=seed,
        featureSubsetStrategy=str(features_per_split), minInstancesPerNode=max(min_split // 2, 1),
    ).fit(rows)


def class_index(column: str, classes=tuple(ATTACK_CLASSES)):
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column)) - 1).cast("double")


def export_ensemble(
    spark: SparkSession, model: RandomForestClassificationModel | DecisionTreeClassificationModel, features: list[str],
) -> DataFrame:
    """Fitted trees as the flat node table."""
    members = getattr(model, "trees", [model])
    rows: list[tuple] = []

    def visit(tree: int, node, counter: list[int]) -> int:
        number = counter[0]
        counter[0] += 1
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            total = sum(stats) or 1.0
            rows.append((tree, number, None, None, None, None, [s / total for s in stats]))
            return number
        left = visit(tree, node.leftChild(), counter)
        right = visit(tree, node.rightChild(), counter)
        split = node.split()
        rows.append((tree, number, features[split.featureIndex()], float(split.threshold()), left, right, None))
        return number

    for t, member in enumerate(members):
        visit(t, member._call_java("rootNode"), [0])
    return spark.createDataFrame(rows, ENSEMBLE_NODE)
