"""Scalers fitted by one aggregate and applied as plain expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.functions.numbers import min_max
from rillwater.operators.quantiles import exact_quantiles

Scale = dict[str, tuple[float, float]]  # column -> (mean, population std)


def fit_standard(df: DataFrame, columns: Sequence[str]) -> Scale:
    """Means and population standard deviations; one row comes back."""
    row = df.agg(*[e for c in columns for e in (F.avg(c), F.stddev_pop(c))]).first()
    return {c: (row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, c in enumerate(columns)}


def standard(name: str, scale: Scale) -> Column:
    """(x - mean) / std; a constant column becomes 0."""
    mean, std = scale[name]
    centred = F.col(name) - F.lit(mean)
    return centred / F.lit(std) if std > 0 else F.when(F.col(name).isNotNull(), F.lit(0.0))


def standardize(df: DataFrame, columns: Sequence[str], scale: Scale | None = None) -> DataFrame:
    scale = fit_standard(df, columns) if scale is None else scale
    return df.withColumns({c: standard(c, scale) for c in columns})


def standard_stage(scale: Scale, suffix: str = "_std") -> SQLTransformer:
    """The fitted scaler as a pipeline stage that can be saved with the model."""
    terms = [f"(`{c}` - {mean!r}D) / {std!r}D AS `{c}{suffix}`" if std > 0
             else f"CASE WHEN `{c}` IS NOT NULL THEN 0D END AS `{c}{suffix}`"
             for c, (mean, std) in scale.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def fill_median(df: DataFrame, train: DataFrame, columns: Sequence[str],
                strategy: str = "bracketed") -> DataFrame:
    """Missing cells to the median of the training rows."""
    medians = {r["variable"]: r["m"] for r in
               exact_quantiles(train, (), columns, {"m": 0.5}, strategy).collect()}
    return df.fillna({c: m for c, m in medians.items() if m is not None})


def impute_and_scale(train: DataFrame, test: DataFrame, columns: Sequence[str],
                     strategy: str = "bracketed") -> tuple[DataFrame, DataFrame]:
    """Median for missing cells, then standard scale; both learnt from ``train`` only."""
    filled = fill_median(train, train, columns, strategy)
    scale = fit_standard(filled, columns)
    return (standardize(filled, columns, scale),
            standardize(fill_median(test, train, columns, strategy), columns, scale))


def minmax_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column to 0..1 over the whole table; constants to 0."""
    row = df.agg(*[e for c in columns for e in (F.min(c), F.max(c))]).first()
    return df.withColumns({c: min_max(F.col(c).cast("double"), row[2 * i], row[2 * i + 1])
                           for i, c in enumerate(columns)})
