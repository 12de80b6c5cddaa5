"""op6: importance weights of all documents, and the sample drawn by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import importance
from flowtide.llm.common import table
from flowtide.llm.queries import query


@query("op6_importance_sample")
def op6_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.resample(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "gumbel_key", "selected")
