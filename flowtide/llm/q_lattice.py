"""op2: near-duplicates among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import lattice
from flowtide.llm.common import table
from flowtide.llm.queries import query


@query("op2_lattice_near_duplicates")
def op2_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))
