"""The feature matrix in sparse form, for categories of any number.

The vocabulary stays a table, numbered in order, and is joined to the rows, so that nothing about it is read by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.ordered import number_rows
from flowtide.operators.cleaning import clean_categoricals, contract_check
from flowtide.schemas import CATEGORICAL, NUMERIC
from flowtide.session import materialise


@dataclass(frozen=True)
class SparsePreprocessor:
    """Statistics of the training rows: of the numeric columns, and (column, value, index) of all their categories.

    Numeric columns come first, then the categories by column and value. ``width`` is the number of columns of the matrix.
    """

    means: tuple[float, ...]
    stds: tuple[float, ...]
    vocabulary: DataFrame
    width: int

    @staticmethod
    def fit(train: DataFrame) -> SparsePreprocessor:
        """One pass for means and population deviations, one for the vocabulary. A column without variance is only centred."""
        cleaned = clean_categoricals(train)
        stats = cleaned.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for c in NUMERIC]).first()
        each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("column"), F.col(c).alias("value")) for k, c in enumerate(CATEGORICAL)])
        values = cleaned.select(F.inline(each)).where("value is not null").distinct()
        numbered = number_rows(values, ["place", "value"], out="index", start=len(NUMERIC))
        vocabulary = materialise(numbered.select("column", "value", F.col("index").cast("int").alias("index")), "vocabulary")
        return SparsePreprocessor(
            tuple(stats[f"m_{c}"] for c in NUMERIC), tuple(stats[f"s_{c}"] or 1.0 for c in NUMERIC), vocabulary,
            len(NUMERIC) + vocabulary.count(),
        )

    def transform(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` and ``features``: (size, indices, values) of the cells that are not zero, by index.

        A category that training rows don't have sets no cell; nor does a null number.
        """
        cleaned = clean_categoricals(contract_check(rows))
        for c in CATEGORICAL:
            # Spark broadcasts a small vocabulary by its size, and splits common values of a large one.
            known = self.vocabulary.where(F.col("column") == c).select(F.col("value").alias(c), F.col("index").alias(f"_at_{c}"))
            cleaned = cleaned.join(known, c, "left")

        def cell(index: Column, value: Column) -> Column:
            return F.struct(index.cast("int").alias("i"), value.cast("double").alias("v"))

        numbers = [cell(F.lit(k), (F.col(c) - F.lit(m)) / F.lit(s)) for k, (c, m, s) in enumerate(zip(NUMERIC, self.means, self.stds))]
        hot = [cell(F.col(f"_at_{c}"), F.lit(1.0)) for c in CATEGORICAL]
        cells = F.filter(F.array(*numbers, *hot), lambda x: x["i"].isNotNull() & x["v"].isNotNull() & (x["v"] != 0))
        found = cleaned.select(*keep, cells.alias("c"))
        return found.select(*keep, F.struct(F.lit(self.width).alias("size"), F.col("c.i").alias("indices"), F.col("c.v").alias("values")).alias("features"))

    def cells(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep``, index and value of each cell that is not zero."""
        found = self.transform(rows, keep)
        return found.select(*keep, F.explode(F.arrays_zip("features.indices", "features.values")).alias("c")).select(
            *keep, F.col("c.indices").alias("index"), F.col("c.values").alias("value")
        )
