"""Figures of whole tables in few passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions import columns
from flowtide.operators import profiling


def test_strip_equals_the_expression(spark):
    values = ["", " ", "a", " a", "a ", "\ta b\n", "a \x85", "\x85 a", "a ", "a  ", "a \r\n", "\xa0a\xa0", "a\x1c", "\x0ba\f", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    both = rows.select(columns.strip(F.col("v")).alias("got"), F.regexp_replace("v", r"^\s+|\s+$", "").alias("want"))
    assert both.where("not got <=> want").count() == 0


def test_aggregates_are_computed_in_groups(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "a long, b double")
    many = [F.max(F.col("a") + k).alias(f"m{k}") for k in range(2 * columns.TOGETHER + 1)]
    found = columns.one_row(rows, many)
    assert [found[f"m{k}"] for k in range(len(many))] == [49 + k for k in range(len(many))]
    assert columns.one_row(rows.limit(0), many)["m80"] is None


def test_a_bracket_of_one_value_needs_no_rows(spark):
    rows = spark.createDataFrame([(1.0, float(i)) for i in range(99)], "same double, rising double")
    found = profiling.exact_medians(rows, ["same", "rising"])
    assert {r["column"]: r["median"] for r in found.collect()} == {"same": 1.0, "rising": 49.0}
    alone = profiling.exact_medians(rows, ["same"])
    assert [r["median"] for r in alone.collect()] == [1.0]
    assert "Window" not in alone._jdf.queryExecution().optimizedPlan().toString()  # nothing is ranked
