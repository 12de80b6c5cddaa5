"""Small column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def round_even(col: Column, digits: int) -> Column:
    """The decimal of ``digits`` places nearest to the binary value, half to even, as the flow records are written.

    The product with the scale is rounded itself, which can only hide on which side of one half it lies. Where it
    shows one half exactly, its error decides, taken from the halves of a split factor (exact for scales of up to 26 bits).
    """
    scale = F.lit(float(10**digits))
    x = col.cast("double")
    product = x * scale
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    tie = product - below == 0.5
    return F.when(tie & (error != 0), F.when(error > 0, below + 1).otherwise(below)).otherwise(F.rint(product)) / scale


# White space, and the line ends before which an end of text is matched too.
_EDGES = " \t\n\x0b\f\r\x85\u2028\u2029"


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` knows only blanks).

    The expression, which costs much more than a comparison, is left to values with such characters at an end.
    """
    text = col.cast("string")
    return F.when(F.btrim(text, F.lit(_EDGES)) == text, text).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


# Aggregates computed together: the code of many more is too long to be compiled, and then each row costs several times as much.
TOGETHER = 40


def one_row(rows: DataFrame, aggregates: Sequence[Column]) -> Row:
    """Named aggregates of the whole table, TOGETHER at a time in one job. Those of one column should be neighbours."""
    parts = [rows.agg(*aggregates[k : k + TOGETHER]) for k in range(0, len(aggregates), TOGETHER)]
    return reduce(DataFrame.crossJoin, parts).first()  # one row each


def lookup(col: Column, table: Mapping, default: str) -> Column:
    """Value of a small fixed table, or the default."""
    result = F.lit(default)
    for key, value in table.items():
        result = F.when(col == F.lit(key), F.lit(value)).otherwise(result)
    return result


def iso_utc(us: Column) -> Column:
    """Epoch microseconds as an ISO-8601 UTC string; a zero fraction is left out."""
    ts = F.timestamp_micros(us)
    return F.when(
        F.pmod(us, F.lit(1_000_000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def count_when(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))
