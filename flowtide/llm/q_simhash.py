"""op8: SimHash classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import simhash
from flowtide.llm.common import table
from flowtide.llm.queries import query


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(simhash.fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
