"""Streaming merge of alert versions into a versioned Parquet table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators.alerts import latest_versions


class AlertSink:
    """Alert versions are appended as a stream; the current table is the latest version of each id.

    Appending needs no read of what is stored, and the file sink's own log makes a repeated batch
    harmless. ``compact`` folds the versions from time to time, after which only newer ones are scanned.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions, self.checkpoint = f"{path}/versions", f"{path}/progress"
        self.compacted = f"{path}/compacted"

    def start(self, versions: DataFrame, **trigger):
        ready = versions.withColumn("status", F.coalesce("status", F.lit("New")))
        return (
            ready.writeStream.format("parquet")
            .option("path", self.versions)
            .option("checkpointLocation", self.checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def run_available(self, versions: DataFrame) -> None:
        self.start(versions).awaitTermination()

    def current(self, key: str = "finding_id") -> DataFrame:
        """The latest version of each id: the last compacted table and the version files written since."""
        versions = self.spark.read.parquet(self.versions)
        last = self._last_run()
        if last is None:
            return latest_versions(versions, key)
        # Spark leaves out older files by their times; a file of the very moment is read again, which changes nothing.
        newer = versions.where(F.col("_metadata.file_modification_time") >= F.lit(last.upto))
        folded = self.spark.read.schema(versions.schema).parquet(f"{self.compacted}/run={last.run}")
        return latest_versions(folded.unionByName(newer), key)

    def compact(self, run: int, key: str = "finding_id") -> str:
        """Write the current table under a new folder, from which ``current`` goes on, and return its path."""
        path = f"{self.compacted}/run={run}"
        times = self.spark.read.parquet(self.versions).select(F.col("_metadata.file_modification_time").alias("t"))
        upto = times.agg(F.max("t")).first()[0]
        self.current(key).write.mode("overwrite").parquet(path)
        note = self.spark.range(1).select(F.lit(run).cast("int").alias("run"), F.lit(upto).alias("upto"))
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/note={run}")
        return path

    def _last_run(self):
        """The last compaction: its number and the time of the last version file in it."""
        try:
            return self.spark.read.parquet(f"{self.path}/runs").orderBy(F.desc("run")).first()
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err):
                return None
            raise
