"""op3: byte-level BPE digests of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import bpe
from flowtide.llm.common import table
from flowtide.llm.queries import query

VOCABULARY = "byte_bpe_50k.tiktoken"


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    )
