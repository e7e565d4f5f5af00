"""Numeric column expressions. None of them can produce NaN."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwater.config import NULL_SENTINELS

# Fixed pattern: a finite decimal number, surrounding blanks allowed. A plain
# try_cast would also accept '5d', 'NaN' and 'inf'.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def blank_sentinels(col: Column, sentinels: Iterable[str] = NULL_SENTINELS) -> Column:
    """Null for texts that mean "no value"; blanks around them do not matter."""
    marks = sorted({s.strip() for s in sentinels})
    return F.when(~F.trim(col).isin(*marks), col)


def parse_number(col: Column) -> Column:
    """Text to double; anything but a finite number becomes null."""
    value = F.trim(col).try_cast("double")
    return F.when(col.rlike(NUMBER_PATTERN) & (F.abs(value) < F.lit(float("inf"))), value)


def finite(col: Column) -> Column:
    """NaN and infinities become null."""
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def round_to(col: Column, digits: int) -> Column:
    """Round half up; summation noise far below the last digit cannot flip it."""
    return F.round(F.round(col, digits + 6), digits)


def total(cols: Sequence[Column]) -> Column:
    """Sum of expressions."""
    return reduce(lambda a, b: a + b, cols)


def row_mean(names: Sequence[str]) -> Column:
    """Mean across columns of one row; nulls do not count, null if all are."""
    summed = total([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    present = total([F.col(c).isNotNull().cast("int") for c in names])
    return F.when(present > 0, summed / F.greatest(present, F.lit(1)))


def share_present(col: Column) -> Column:
    """Aggregate: percentage of rows in which the column has a value."""
    return F.avg(F.when(col.isNotNull(), F.lit(100.0)).otherwise(F.lit(0.0)))


def outside(col: Column, low: Column, high: Column) -> Column:
    """Outlier flag; null bounds flag nothing, null values stay null."""
    return F.when(col.isNotNull(), F.coalesce((col < low) | (col > high), F.lit(False)))


def min_max(col: Column, low: float | None, high: float | None) -> Column:
    """Scale to 0..1; a constant column gives 0."""
    if low is None or high is None or high == low:
        return F.when(col.isNotNull(), F.lit(0.0))
    return (col - F.lit(float(low))) / F.lit(float(high) - float(low))
