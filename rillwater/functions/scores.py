"""Goodness-of-fit aggregates over observed and predicted columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_sums(observed: str, predicted: str) -> list[Column]:
    """The partial sums every score is made of; combine map-side."""
    y, p = F.col(observed), F.col(predicted)
    both = y.isNotNull() & p.isNotNull()
    return [
        F.count(F.when(both, 1)).alias("n"),
        F.sum(F.when(both, (p - y) * (p - y))).alias("sse"),
        (F.var_pop(F.when(both, y)) * F.count(F.when(both, 1))).alias("sst"),
        F.sum(F.when(both, p - y)).alias("bias"),
        F.sum(F.when(both, y)).alias("obs"),
    ]


def score_columns() -> dict[str, Column]:
    """R2, RMSE, PBIAS and NSE from the columns of ``fit_sums``."""
    sse, sst = F.col("sse"), F.col("sst")
    skill = 1 - F.try_divide(sse, sst)
    return {
        "R2": F.when(F.col("n") < 2, None)
        .when(sst > 0, skill)
        .when(sse == 0, F.lit(1.0))
        .when(sse > 0, F.lit(0.0)),
        "RMSE": F.sqrt(F.try_divide(sse, F.col("n"))),
        "PBIAS": 100 * F.try_divide(F.col("bias"), F.col("obs")),
        "NSE": F.when(sst > 0, skill),
    }
