"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors can't take it along."""
    return materialise(df, f"llm-{name}")


def _is_scan(df: DataFrame) -> bool:
    """Whether df is Parquet files with nothing but filters and projections that give the same every time."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.child()
    if not plan.getClass().getName().endswith(".LogicalRelation"):
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def numbered(df: DataFrame, name: str, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """df with a unique long ``name`` in the order in which rows are read, the same whenever it is evaluated.

    Rows of Parquet files are numbered by their files, in the order of their paths, and their places there, so that they can be read again
    and no copy of them lies on disk. Anything else is stored by ``keep``.
    """
    if not _is_scan(df):
        return keep(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    own, file, first = df.metadataColumn("_metadata"), spare(df, "_file"), spare(df, "_first")
    rows = df.select("*", own["file_path"].alias(file), own["row_index"].alias(name))
    files = sorted(r[0] for r in rows.select(file).distinct().collect())
    if len(files) > 1:
        numbers = df.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"`{file}` string, `{first}` long")
        rows = rows.join(F.broadcast(numbers), file).withColumn(name, F.col(name) + F.col(first))
    return rows.select(*df.columns, name)


def spare(df: DataFrame, name: str) -> str:
    """A name for a column of our own beside those of df, whatever they are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of df (which is read twice) by the hash of a unique key, or all if there are no more.

    The share is set so that more than ``most`` are as good as impossible: four deviations below it.
    """
    total = df.count()
    if total <= most:
        return df
    share = max(0.0, most - 4 * most**0.5) / total
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))


def crc_of(column: str) -> Column:
    """crc32 of a column as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts(batch: pa.RecordBatch, column: int | str) -> Iterator[str]:
    """The texts of one column, one at a time; null reads as the empty text."""
    for value in batch.column(column):
        yield value.as_py() or ""


_held: dict[tuple, object] = {}  # what a worker process keeps from one task to the next
_used: set[tuple] = set()  # what the task at hand has asked for


def held(make: Callable) -> Callable:
    """Like functools.cache, but a worker lets go of everything once it scans for a step that asks for none of it."""

    @wraps(make)
    def get(*args):
        key = (make, *args)
        _used.add(key)
        if key not in _held:
            _held[key] = make(*args)
        return _held[key]

    return get


def begun(build: Callable):
    """What ``build`` gives, in the worker's own module: a task's functions arrive with copies of the names they use."""
    _used.clear()
    step = build()
    if not _used:
        _held.clear()
    return step


# Rows of a batch in a Python worker. Texts may be long, so batches are short; the session's setting counts if it is less.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scan(df: DataFrame, build: Callable[[], Callable | tuple[Callable, Callable]], schema: str) -> DataFrame:
    """mapInArrow with one set-up per task.

    ``build`` gives the function that turns a batch into columns (any number of times), and may give another
    one for what is left at the end of the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        step = begun(build)
        step, finish = step if isinstance(step, tuple) else (step, tuple)
        for batch in batches:
            yield from step(batch)
        yield from finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in columns_of(batches):
            yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], names=arrow.names)

    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, out)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)
