"""The registry of check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwater.functions.numbers import round_to

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns rounded for comparison; whole numbers as bigint."""
    cols = []
    for f in df.schema.fields:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            col = round_to(col, digits)
        elif kind in ("integer", "short", "byte"):
            col = col.cast("bigint")
        cols.append(col.alias(f.name))
    return df.select(*cols)


def load() -> None:
    from checkviews import (cleaning_queries, combo_queries, feature_queries, file_queries,  # noqa: F401
                            model_queries, report_queries, summary_queries)
