"""Outlier bounds and their treatment."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.functions.numbers import outside
from rillwater.operators.cleaning import existing
from rillwater.operators.quantiles import exact_quantiles

# Usual parameters of the two rules, and the modified-z constant.
IQR_MULTIPLIER = 1.5
MAD_THRESHOLD = 3.5
MODIFIED_Z = 0.6745

Bounds = dict[str, tuple[float, float]]


def _scaled(df: DataFrame, columns: Sequence[str], log_columns: Sequence[str]) -> DataFrame:
    return df.select(*[(F.log1p(c) if c in log_columns else F.col(c).cast("double")).alias(c)
                       for c in columns])


def _per_variable(table: DataFrame) -> dict[str, tuple]:
    """A table of one row per variable, as many rows as there are columns."""
    return {r["variable"]: tuple(r)[1:] for r in table.collect()}


def iqr_bounds(df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER,
               log_columns: Sequence[str] = (), strategy: str = "bracketed") -> Bounds:
    """[Q1 - m*IQR, Q3 + m*IQR] of every column.

    For log columns the rule works on log1p and the bounds are mapped back.
    """
    columns = existing(df, columns)
    table = exact_quantiles(_scaled(df, columns, log_columns), (), columns,
                            {"q1": 0.25, "q3": 0.75}, strategy)
    bounds = {v: (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
              for v, (q1, q3) in _per_variable(table).items() if q1 is not None}
    return {v: (math.expm1(lo), math.expm1(hi)) if v in log_columns else (lo, hi)
            for v, (lo, hi) in bounds.items()}


def mad_bounds(df: DataFrame, columns: Sequence[str], threshold: float = MAD_THRESHOLD,
               log_columns: Sequence[str] = (), strategy: str = "bracketed") -> Bounds:
    """Extreme values whose modified z is within the threshold.

    For log columns z is taken on log1p. The bounds are values of the data, not
    mapped back from the log scale, so rounding cannot push them past themselves.
    Columns whose median absolute deviation is zero have no bounds.
    """
    columns = existing(df, columns)
    scaled = _scaled(df, columns, log_columns)
    half = {"median": 0.5}
    middle = {v: m for v, (m,) in _per_variable(
        exact_quantiles(scaled, (), columns, half, strategy)).items() if m is not None}
    away = scaled.select(*[F.abs(F.col(c) - F.lit(m)).alias(c) for c, m in middle.items()])
    spread = {v: m for v, (m,) in _per_variable(
        exact_quantiles(away, (), list(middle), half, strategy)).items() if m} if middle else {}
    if not spread:
        return {}
    value = {c: F.log1p(c) if c in log_columns else F.col(c).cast("double") for c in spread}
    z = {c: F.lit(MODIFIED_Z) * (value[c] - F.lit(middle[c])) / F.lit(mad)
         for c, mad in spread.items()}
    row = df.agg(*[e for c in spread for e in (
        F.min(F.when(z[c] >= -threshold, F.col(c))),
        F.max(F.when(z[c] <= threshold, F.col(c))))]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(spread)}


def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr",
                   log_columns: Sequence[str] = (), multiplier: float = IQR_MULTIPLIER,
                   threshold: float = MAD_THRESHOLD, strategy: str = "bracketed") -> Bounds:
    """Bounds on the original scale. An unknown method warns and bounds nothing."""
    if method == "iqr":
        return iqr_bounds(df, columns, multiplier, log_columns, strategy)
    if method == "mad":
        return mad_bounds(df, columns, threshold, log_columns, strategy)
    warnings.warn(f"unknown outlier method {method!r}")
    return {}


def bounds_table(df: DataFrame, bounds: Bounds) -> DataFrame:
    rows = [(c, float(lo), float(hi)) for c, (lo, hi) in bounds.items()]
    return df.sparkSession.createDataFrame(rows, "variable string, low double, high double")


def flag_outliers(df: DataFrame, bounds: Bounds, suffix: str = "_is_outlier") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": outside(F.col(c), F.lit(lo), F.lit(hi))
                           for c, (lo, hi) in bounds.items()})


def treat_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr",
                   strategy: str = "remove", log_columns: Sequence[str] = (),
                   multiplier: float = IQR_MULTIPLIER, threshold: float = MAD_THRESHOLD,
                   quantiles: str = "bracketed") -> DataFrame:
    """Outliers to null (``remove``) or to the bound (``winsorize``), all columns in one pass.

    An unknown method or strategy leaves the table as it is.
    """
    if strategy not in ("remove", "winsorize"):
        warnings.warn(f"unknown outlier strategy {strategy!r}")
        return df
    bounds = outlier_bounds(df, columns, method, log_columns, multiplier, threshold, quantiles)
    treated = {}
    for c, (lo, hi) in bounds.items():
        value = F.col(c).cast("double")
        if strategy == "winsorize":
            # least and greatest skip nulls, so missing cells must be kept apart.
            treated[c] = F.when(value.isNotNull(),
                                F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))
        else:
            treated[c] = F.when(value.between(lo, hi), value)
    return df.withColumns(treated) if treated else df
