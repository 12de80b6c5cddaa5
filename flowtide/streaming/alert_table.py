"""The alert table in hash buckets, with counts that are kept up to date.

A batch rewrites the buckets that hold its ids, under a folder of its own, and then notes where each bucket now is. The note is
what counts: what a batch that failed has written is not seen, and one that comes again is not applied again. A look-up of
an id reads one bucket. Each rewritten row also tells which status and severity it replaced, so the counts change by -1 and +1
for the rows of the batch, whatever the table holds.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.schemas import STATUSES

BUCKETS = 64
_NOTE = "bucket int, at long"
_COUNTED = ["status", "severity"]


class AlertTable:
    """Alerts by ``key``, the latest version of each; ``apply`` is the ``foreachBatch`` function.

    The number of buckets is set when the table is made: it should give buckets that one task can rewrite.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "finding_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def start(self, versions: DataFrame, **trigger):
        return (
            versions.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/query")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def _bucket(self, value) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _read(self, path: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.parquet(f"{self.path}/{path}")
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err):
                return None
            raise

    def last_batch(self) -> int:
        """The last batch that counts, or -1."""
        notes = self._read("notes", f"{_NOTE}, batch long")
        last = notes.agg(F.max("batch")).first()[0] if notes is not None else None
        return -1 if last is None else last

    def _places(self, batch: int) -> dict[int, int]:
        """For each bucket with rows, the batch that wrote it last: at most as many as there are buckets."""
        if batch < 0:
            return {}
        return {r["bucket"]: r["at"] for r in self._read(f"notes/batch={batch}", _NOTE).collect()}

    def _rows(self, places: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={at}/bucket={b}" for b, at in sorted(places.items())]
        return self.spark.read.parquet(*paths).drop("was") if paths else None

    def current(self) -> DataFrame | None:
        """All alerts; None before the first batch."""
        return self._rows(self._places(self.last_batch()))

    def lookup(self, value: str) -> DataFrame | None:
        """The alert with an id, from its bucket alone; None if that bucket holds nothing."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(value))).first()[0]
        places = self._places(self.last_batch())
        found = self._rows({bucket: places[bucket]} if bucket in places else {})
        return None if found is None else found.where(F.col(self.key) == value)

    def apply(self, versions: DataFrame, batch: int) -> None:
        """Merge alert versions: the one with the highest number stays, a missing status means New. Rows without an id are left out."""
        last = self.last_batch()
        if batch <= last:
            return
        places = self._places(last)
        new = versions.where(F.col(self.key).isNotNull()).withColumn("status", F.coalesce("status", F.lit("New")))
        # Written first: a stream's batch is read twice.
        incoming = self._store(new.withColumn("bucket", self._bucket(self.key)), "incoming", batch)
        touched = sorted(r["bucket"] for r in incoming.select("bucket").distinct().collect())
        names = [c for c in incoming.columns if c not in (self.key, "bucket")]
        rows = incoming.drop("bucket").withColumn("_old", F.lit(False))
        old = self._rows({b: places[b] for b in touched if b in places})
        if old is not None:
            rows = rows.unionByName(old.withColumn("_old", F.lit(True)))
        before = F.max(F.when(F.col("_old"), F.struct(*_COUNTED))).alias("was")  # one old row for each id at most
        merged = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct("version", "_old")).alias("v"), before)
        merged = merged.select(self.key, "v.*", "was").withColumn("bucket", self._bucket(self.key))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        places |= {b: batch for b in touched}
        self._count(places, touched, last, batch)
        note = self.spark.createDataFrame(sorted(places.items()), _NOTE)
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/notes/batch={batch}")

    def _store(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        path = f"{self.path}/{kind}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _count(self, places: dict[int, int], touched: list[int], last: int, batch: int) -> None:
        """Counts after a batch: those before it, less what its rows replaced, and what they are."""
        schema = "status string, severity string, n long"
        counts = self._read(f"counts/batch={last}", schema) if last >= 0 else self.spark.createDataFrame([], schema)
        if touched:
            paths = [f"{self.path}/data/batch={places[b]}/bucket={b}" for b in touched]
            now = F.struct(*_COUNTED)
            fresh = self.spark.read.parquet(*paths).where(F.col("was").isNull() | (F.col("was") != now))
            change = F.explode(F.array(F.struct(now.alias("c"), F.lit(1).alias("n")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("n"))))
            fresh = fresh.select(change.alias("x")).where("x.c is not null").select("x.c.*", F.col("x.n").cast("long").alias("n"))
            counts = counts.unionByName(fresh)
        counts = counts.groupBy(*_COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch}")

    def counts(self, batch: int | None = None) -> DataFrame:
        """(status, severity, n) after a batch, the last one by default."""
        found = self._read(f"counts/batch={self.last_batch() if batch is None else batch}", "status string, severity string, n long")
        return self.spark.createDataFrame([], "status string, severity string, n long") if found is None else found

    def statistics(self, batch: int | None = None) -> DataFrame:
        """What ``alert_statistics`` gives, from the counts."""
        n = F.col("n")

        def total(cond) -> Column:
            return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

        return self.counts(batch).agg(
            total(F.lit(True)).alias("total_alerts"),
            *[total(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES],
            total(F.col("severity").isin("CRITICAL", "HIGH")).alias("high_priority_count"),
        )
