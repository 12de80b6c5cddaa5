"""Session helpers: settings we recommend, and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this library should run with.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Methods above this size are never compiled by the JVM; Spark then splits the code instead.
    # Wide aggregates and tree ensembles run several times faster for it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a running session."""
    for name, value in RECOMMENDED.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a session in one process, as in tests, may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="run-")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and fixes the outcome of anything
    that may differ between two evaluations, such as sampled range bounds.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` once all that reads them is written, and release what Spark still holds for finished jobs."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that are over: it does so once their objects have been collected.

    The first collection frees what Python held, the second what hung on that.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _own_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_folder(spark)}/flowtide/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Results that still read them must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
