"""Cleaning, contract checks and the feature matrix of labelled flows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.columns import one_row, strip
from flowtide.schemas import (
    CATEGORICAL,
    EXPECTED_FEATURES,
    LABELLED_FLOW,
    NUMERIC,
    ROW_ID,
    TARGET,
    TARGET_CLASS,
)

# A vocabulary becomes columns of the dense matrix, so its size is bounded.
MAX_VOCABULARY = 10_000


def clean_categoricals(rows: DataFrame) -> DataFrame:
    """Strip the text columns and name the placeholders; case is kept. A null reads as "nan", as text."""
    cleaned = {}
    for name in CATEGORICAL:
        if name in rows.columns:
            value = F.coalesce(strip(F.col(name)), F.lit("nan"))
            if name == "service":
                cleaned[name] = F.when(value.isin("-", ""), "none").otherwise(value)
            else:
                cleaned[name] = F.when(value == "", "unknown").otherwise(value)
    return rows.withColumns(cleaned)


def split_labels(rows: DataFrame) -> DataFrame:
    """Targets, as far as the table has them."""
    targets = []
    if TARGET in rows.columns:
        targets.append(F.col(TARGET))
    if TARGET_CLASS in rows.columns:
        targets.append(strip(F.col(TARGET_CLASS)).alias(TARGET_CLASS))
    return rows.select(*[c for c in (ROW_ID,) if c in rows.columns], *targets)


def drop_leakage(rows: DataFrame) -> DataFrame:
    return rows.drop(ROW_ID, TARGET, TARGET_CLASS)


def contract_check(rows: DataFrame, expected: Sequence[str] = EXPECTED_FEATURES) -> DataFrame:
    """Raise if a required column is missing; the check reads the schema only."""
    missing = [c for c in expected if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required features: {missing}; expected {len(expected)} features")
    return rows


def order_columns(rows: DataFrame, expected: Sequence[str] = EXPECTED_FEATURES) -> DataFrame:
    return rows.select(*expected)


def features_and_labels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features in contract order, targets)."""
    cleaned = clean_categoricals(rows)
    return order_columns(contract_check(drop_leakage(cleaned))), split_labels(cleaned)


def validate_rows(raw: DataFrame, schema: T.StructType = LABELLED_FLOW) -> DataFrame:
    """Try every required column against its type; ``reasons`` lists what failed, extras are dropped.

    Rows with no reasons are valid; the others belong in quarantine.
    """
    fields = [f for f in schema.fields if f.name in EXPECTED_FEATURES]
    absent = [f.name for f in fields if f.name not in raw.columns]

    def typed(f: T.StructField) -> Column:
        if f.name in absent:
            return F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            return F.col(f.name).cast("string")
        return F.col(f.name).try_cast(f.dataType.simpleString())

    def reason(f: T.StructField) -> Column:
        if f.name in absent:
            return F.lit(f"{f.name}: missing")
        given = F.col(f.name)
        return F.when(given.isNull(), F.lit(f"{f.name}: missing")).when(typed(f).isNull(), F.lit(f"{f.name}: invalid"))

    ids = [c for c in (ROW_ID,) if c in raw.columns]
    return raw.select(
        *ids,
        *[typed(f).alias(f.name) for f in fields],
        F.array_compact(F.array(*[reason(f) for f in fields])).alias("reasons"),
    )


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_rows(raw)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


@dataclass(frozen=True)
class Preprocessor:
    """Statistics of the training rows; applying it to other rows is a plain projection."""

    means: tuple[float, ...]
    stds: tuple[float, ...]
    vocabularies: tuple[tuple[str, ...], ...]

    @staticmethod
    def fit(train: DataFrame, max_vocabulary: int = MAX_VOCABULARY) -> Preprocessor:
        """One job for means and population deviations, one for the sorted vocabularies.

        A column with more than ``max_vocabulary`` values is an error here; SparsePreprocessor takes any number.
        """
        cleaned = clean_categoricals(train)
        stats = one_row(cleaned, [a for c in NUMERIC for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
        values = (
            cleaned.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in CATEGORICAL])))
            .filter(F.col("v").isNotNull())
            .distinct()
            .limit(len(CATEGORICAL) * (max_vocabulary + 1))  # reached only if a column has too many
            .collect()
        )
        for c in CATEGORICAL:
            if sum(r["c"] == c for r in values) > max_vocabulary:
                raise ValueError(f"column {c} has too many values to one-hot encode")
        return Preprocessor(
            tuple(stats[f"m_{c}"] for c in NUMERIC),
            tuple(stats[f"s_{c}"] or 1.0 for c in NUMERIC),
            tuple(tuple(sorted(r["v"] for r in values if r["c"] == c)) for c in CATEGORICAL),
        )

    @property
    def names(self) -> list[str]:
        """Column names of the matrix."""
        hot = [f"{c}_{v}" for c, vocabulary in zip(CATEGORICAL, self.vocabularies) for v in vocabulary]
        return [*NUMERIC, *hot]

    def scaled(self) -> dict[str, Column]:
        return {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(NUMERIC, self.means, self.stds)}

    def one_hot(self) -> dict[str, Column]:
        """A value outside the vocabulary sets none of its columns."""
        return {
            f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0)
            for c, vocabulary in zip(CATEGORICAL, self.vocabularies)
            for v in vocabulary
        }

    def transform(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Cleaned, scaled and encoded rows with one ``features`` array in the order of ``names``."""
        cleaned = clean_categoricals(contract_check(rows))
        cells = self.scaled() | self.one_hot()
        return cleaned.select(*keep, F.array(*[cells[n] for n in self.names]).alias("features"))

    def vectors(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The same with an ML vector column, for training."""
        from pyspark.ml.functions import array_to_vector

        return self.transform(rows, keep).withColumn("features", array_to_vector("features"))
