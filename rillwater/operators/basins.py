"""Basin attributes: building the table, inheriting rows, joining, checking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.functions.keys import clean_key
from rillwater.plans.keep import cached, settle


def parameter_names(long: DataFrame, parameter: str = "Parameter") -> list[str]:
    """Names the wide table gets as columns (a schema decision)."""
    return [r[0] for r in long.select(parameter).distinct().orderBy(parameter).collect()]


def pivot_parameters(long: DataFrame, keys: Sequence[str], order: str,
                     names: Sequence[str] | None = None, parameter: str = "Parameter",
                     value: str = "Value") -> DataFrame:
    """One row per station; of repeated parameters the last by ``order`` counts."""
    names = parameter_names(long, parameter) if names is None else list(names)
    last = [F.max_by(F.when(F.col(parameter) == n, F.col(value)),
                     F.when(F.col(parameter) == n, F.col(order))).alias(n) for n in names]
    return long.groupBy(*keys).agg(*last)


def inherit_rows(basins: DataFrame, mapping: DataFrame, station: str = "station_code",
                 child: str = "child", parent: str = "parent") -> DataFrame:
    """Add rows for children that are absent, copied from a parent that exists."""
    # One row per station, used three times below.
    table = cached(basins.withColumn(station, clean_key(F.col(station))))
    wanted = mapping.select(clean_key(F.col(child)).alias(child),
                            clean_key(F.col(parent)).alias(parent)).distinct()
    absent = wanted.join(table.select(F.col(station).alias(child)), child, "left_anti")
    copies = (absent.join(table, F.col(parent) == F.col(station))
              .drop(station, parent).withColumnRenamed(child, station))
    return table.unionByName(copies)


def join_basins(samples: DataFrame, basins: DataFrame, station: str = "station_code",
                how: str = "left", suffix: str = "_cuenca", settled: bool = False) -> DataFrame:
    """Join attributes to samples; clashing names on the right get the suffix.

    Few stations are broadcast after a check of their size (``settled`` if that is
    done already); with many, a station that holds a large share is split by AQE.
    """
    left = samples.withColumn(station, clean_key(F.col(station)))
    right = basins.withColumn(station, clean_key(F.col(station)))
    clashes = [c for c in right.columns if c in left.columns and c != station]
    right = right.withColumnsRenamed({c: c + suffix for c in clashes})
    return left.join(right if settled else settle(right), station, how)


def unmatched_stations(samples: DataFrame, basins: DataFrame,
                       station: str = "station_code") -> DataFrame:
    """Stations of the samples that have no row in the basin table."""
    # Distinct first: the anti join then sees one row per station, not per sample.
    seen = samples.select(clean_key(F.col(station)).alias(station)).distinct()
    known = basins.select(clean_key(F.col(station)).alias(station))
    return seen.join(known, station, "left_anti")


def missing_expected(expected: DataFrame, found: DataFrame,
                     station: str = "station_code") -> DataFrame:
    """Expected stations that were not found; letter case does not matter."""
    return (expected.select(F.upper(station).alias(station)).distinct()
            .join(found.select(F.upper(station).alias(station)), station, "left_anti"))


def assignment_check(samples: DataFrame, roles: Roles, geometry: str | None = None) -> DataFrame:
    """Totals as (check, label, n): rows, gaps, repeated visits, rows per basin."""
    # One pass over the samples, combined map-side to (station, date) counts.
    shape = F.col(geometry).isNull() if geometry else F.lit(True)
    visits = samples.groupBy(roles.station, roles.date).agg(
        F.count("*").alias("n"),
        F.sum(shape.cast("bigint")).alias("no_shape"),
        F.sum(F.col(roles.basin).isNull().cast("bigint")).alias("no_basin"))
    totals = visits.agg(
        F.sum("n").alias("rows"), F.sum("no_basin").alias("rows_without_basin"),
        F.sum("no_shape").alias("rows_without_geometry"),
        F.sum(F.col("n") - 1).alias("repeated_visits"))
    names = totals.columns
    figures = totals.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.lit(None).cast("string").alias("label"),
                 F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n")) for n in names
    ])).alias("r")).select("r.*")
    per_basin = (samples.where(F.col(roles.basin).isNotNull()).groupBy(roles.basin)
                 .agg(F.count("*").alias("n"))
                 .select(F.lit("rows_of_basin").alias("check"),
                         F.col(roles.basin).alias("label"), "n"))
    return figures.unionByName(per_basin)


def inherited_map(spark, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """The configured (child, parent) pairs as a table."""
    return spark.createDataFrame(list(pairs), "child string, parent string")
