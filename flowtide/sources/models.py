"""Storing and loading models: node tables and matched pairs of preprocessor and classifier."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegressionModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowtide.operators.cleaning import Preprocessor
from flowtide.operators.scoring import Ensemble
from flowtide.schemas import ENSEMBLE_NODE
from flowtide.session import shared_folder

_CLASSES = {
    "DecisionTreeClassifier": DecisionTreeClassificationModel,
    "LogisticRegression": LogisticRegressionModel,
}


def _new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/flowtide/{kind}-{uuid.uuid4().hex}"


def save_manifest(spark: SparkSession, rows: Iterable[dict], path: str | None = None) -> str:
    """Write the node rows of an ensemble as JSON lines."""
    path = path or _new_path(spark, "manifest")
    data = [tuple(r[f.name] for f in ENSEMBLE_NODE.fields) for r in rows]
    spark.createDataFrame(data, ENSEMBLE_NODE).coalesce(1).write.json(path)
    return path


def load_manifest(spark: SparkSession, path: str) -> Ensemble:
    return Ensemble.from_table(spark.read.schema(ENSEMBLE_NODE).json(path))


@dataclass(frozen=True)
class Bundle:
    preprocessor: Preprocessor
    model: object
    model_name: str
    metadata: dict


def save_bundle(
    spark: SparkSession, preprocessor: Preprocessor, model, model_name: str, metadata: dict | None = None,
    path: str | None = None,
) -> str:
    """Save both parts under one path, so that a model never meets another preprocessor."""
    if model_name not in _CLASSES:
        raise ValueError(f"unknown model {model_name!r}")
    path = path or _new_path(spark, "bundle")
    model.write().overwrite().save(f"{path}/model")
    state = {
        "model_name": model_name, "metadata": metadata or {}, "means": preprocessor.means,
        "stds": preprocessor.stds, "vocabularies": preprocessor.vocabularies, "features": preprocessor.names,
    }
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/preprocessor")
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    state = json.loads(spark.read.text(f"{path}/preprocessor").select(F.col("value")).first()[0])
    prep = Preprocessor(
        tuple(state["means"]), tuple(state["stds"]), tuple(tuple(v) for v in state["vocabularies"])
    )
    if prep.names != state["features"]:
        raise ValueError("the stored feature names do not fit the preprocessor")
    model = _CLASSES[state["model_name"]].load(f"{path}/model")
    return Bundle(prep, model, state["model_name"], state["metadata"])
