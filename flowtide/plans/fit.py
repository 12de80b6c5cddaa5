"""Offline training: preprocessor on the training rows only, two classifiers, metrics, champion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from flowtide.operators.cleaning import Preprocessor
from flowtide.operators.evaluation import binary_metrics, champion, roc_auc
from flowtide.operators.training import train_logistic, train_tree
from flowtide.schemas import DETECTION_THRESHOLD, TARGET
from flowtide.session import materialise
from flowtide.sources.models import save_bundle

TREE, LOGISTIC = "DecisionTreeClassifier", "LogisticRegression"


@dataclass(frozen=True)
class Fitted:
    paths: dict[str, str]
    metrics: dict[str, dict]
    champion: str


def fit_baselines(train: DataFrame, test: DataFrame, folder: str, threshold: float = DETECTION_THRESHOLD) -> Fitted:
    """Fit and store both classifiers with their test metrics; the tree wins a draw on F1."""
    spark = train.sparkSession
    prep = Preprocessor.fit(train)
    # Both are read by every step of the fits and by every figure about them.
    ready, held = (materialise(prep.vectors(rows, [TARGET]), "matrix") for rows in (train, test))
    models = {LOGISTIC: train_logistic(ready), TREE: train_tree(ready)}
    tables, metrics, paths = {}, {}, {}
    for name, model in models.items():
        scored = model.transform(held).withColumn("p", vector_to_array("probability")[1])
        tables[name] = binary_metrics(scored, label=TARGET, threshold=threshold)
        metrics[name] = tables[name].first().asDict() | {"roc_auc": roc_auc(scored, label=TARGET).first()["roc_auc"]}
        paths[name] = save_bundle(spark, prep, model, name, {"test_metrics": metrics[name]}, f"{folder}/{name}")
    return Fitted(paths, metrics, champion(tables, tie=TREE).first()["champion"])
