"""Pearson correlations over the rows in which both variables are present."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.operators.cleaning import numeric_columns
from rillwater.operators.products import cross_products, means

# Variation below this share of the squares is rounding: the variable is constant.
ROUNDING = 1e-13


def correlations(df: DataFrame, columns: Sequence[Column], last_only: bool = False) -> np.ndarray:
    """Pairwise-complete correlation matrix; NaN where undefined. With ``last_only`` the last column of it.

    Two scans: one for the means, one for the products around them, so that large
    offsets do not eat up the digits.
    """
    centred = [c.cast("double") - F.lit(m) for c, m in zip(columns, means(df, columns))]
    found = cross_products(df, centred, last_only=last_only).get(0)
    if found is None:
        return np.full((len(columns), 1 if last_only else len(columns)), np.nan)
    n = np.where(found.both > 0, found.both, np.nan)
    cov = found.product - found.first * found.other / n
    spread = []
    for total, square in ((found.first, found.square), (found.other, found.other_square)):
        var = square - total ** 2 / n
        spread.append(np.where(var > ROUNDING * square, var, np.nan))
    return np.where(found.both >= 2, cov / np.sqrt(spread[0] * spread[1]), np.nan)


def _number(r: float) -> float | None:
    return None if np.isnan(r) else float(max(-1.0, min(1.0, r)))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Lower triangle of the matrix as (variable, other, r), numeric features only."""
    names = [f for f in features if f in numeric_columns(df)]
    r = correlations(df, [F.col(f"`{c}`") for c in names]) if names else None
    rows = [(names[i], names[j], _number(r[i, j])) for i in range(len(names)) for j in range(i)]
    return df.sparkSession.createDataFrame(rows, "variable string, other string, r double")


def target_correlation(df: DataFrame, features: Sequence[str], target: str,
                       log: bool = True) -> DataFrame:
    """Correlation of each numeric feature with the (log) target, largest first."""
    names = [f for f in features if f in numeric_columns(df) and f != target]
    y = F.log1p(target) if log else F.col(target)
    r = correlations(df, [*[F.col(f"`{c}`") for c in names], y], last_only=True)
    rows = [(c, _number(r[i, -1])) for i, c in enumerate(names)]
    table = df.sparkSession.createDataFrame(rows, "variable string, r double")
    return table.orderBy(F.col("r").desc_nulls_last(), "variable")
