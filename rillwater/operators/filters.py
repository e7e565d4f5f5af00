"""Row and station filters, and the account of what they drop."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.config import RobustFilterParams, Roles
from rillwater.functions.numbers import total
from rillwater.operators.cleaning import existing
from rillwater.plans.keep import cached, settle


def complete_columns(df: DataFrame, roles: Roles, features: Sequence[str]) -> list[str]:
    return [roles.target, *[f for f in existing(df, features) if f != roles.target]]


def complete_cases(df: DataFrame, roles: Roles, features: Sequence[str]) -> DataFrame:
    """Rows with target and every listed feature that the table has."""
    return df.dropna(subset=complete_columns(df, roles, features))


def stations_with(df: DataFrame, roles: Roles, min_rows: int) -> DataFrame:
    return (df.where(F.col(roles.station).isNotNull()).groupBy(roles.station)
            .agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select(roles.station))


def min_station_rows(df: DataFrame, roles: Roles, min_rows: int) -> DataFrame:
    """Rows of stations with at least ``min_rows`` rows; 0 switches it off."""
    if min_rows <= 0:
        return df
    return df.join(settle(stations_with(df, roles, min_rows)), roles.station, "left_semi")


def in_set(df: DataFrame, name: str, members: DataFrame) -> DataFrame:
    """Membership in a table of values."""
    return df.join(members.select(name).distinct(), name, "left_semi")


def enough_rows(df: DataFrame, least: int = 20) -> bool:
    return df.limit(least).count() >= least


def _per_station(df: DataFrame, roles: Roles, features: Sequence[str]) -> DataFrame:
    """Rows and complete rows per station: all the funnel needs, from one scan."""
    whole = F.lit(True)
    for c in complete_columns(df, roles, features):
        whole = whole & F.col(c).isNotNull()
    return df.groupBy(roles.station).agg(
        F.count("*").alias("n_all"), F.sum(whole.cast("bigint")).alias("n_complete"))


def filter_funnel(df: DataFrame, roles: Roles, features: Sequence[str],
                  min_rows: int) -> DataFrame:
    """Rows and stations left after each stage of the complete-case filter."""
    stations = _per_station(df, roles, features)
    known = F.col(roles.station).isNotNull()
    full = F.col("n_complete") > 0
    kept = full & (F.col("n_complete") >= min_rows) & (known if min_rows > 0 else F.lit(True))
    sums = stations.agg(
        F.sum("n_all").alias("rows0"), F.count(F.when(known, 1)).alias("stations0"),
        F.sum("n_complete").alias("rows1"), F.count(F.when(full & known, 1)).alias("stations1"),
        F.sum(F.when(kept, F.col("n_complete")).otherwise(0)).alias("rows2"),
        F.count(F.when(kept & known, 1)).alias("stations2"))
    names = ("start", "complete_cases", "min_station_rows")
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"),
                 F.coalesce(F.col(f"rows{i}"), F.lit(0)).alias("n_rows"),
                 F.col(f"stations{i}").alias("n_stations"))
        for i, n in enumerate(names)])).alias("r")).select("r.*")


def dropped_stations(df: DataFrame, roles: Roles, features: Sequence[str],
                     min_rows: int) -> DataFrame:
    """(stage, station) for every station a stage of the filter removes."""
    stations = _per_station(df, roles, features).where(F.col(roles.station).isNotNull())
    stage = (F.when(F.col("n_complete") == 0, "complete_cases")
             .when(F.col("n_complete") < min_rows, "min_station_rows"))
    return (stations.select(stage.alias("stage"), roles.station)
            .where(F.col("stage").isNotNull()))


@dataclass(frozen=True)
class RobustFilter:
    rows: DataFrame
    stations: DataFrame
    features: list[str]
    dropped: DataFrame  # (stage, kind, name): what each stage takes out


def robust_filter(df: DataFrame, roles: Roles, feature_set: Sequence[str],
                  params: RobustFilterParams, extra: Sequence[str] = ()) -> RobustFilter:
    """Three stages: stations with enough targets, variables complete enough over
    their target rows, stations in which enough of those variables are complete.

    ``extra`` are features outside the water variables; they are not judged.
    Rows without target stay. All three stages work on one count table per station.
    """
    water = existing(df, roles.features)
    has_target = F.col(roles.target).isNotNull()
    counts = cached(df.where(F.col(roles.station).isNotNull()).groupBy(roles.station).agg(
        F.count("*").alias("n"), F.count(roles.target).alias("n_target"),
        *[F.count(c).alias(f"all{i}") for i, c in enumerate(water)],
        *[F.count(F.when(has_target, F.col(c))).alias(f"with{i}") for i, c in enumerate(water)]))
    first = counts.where(F.col("n_target") >= params.min_samples_target)
    row = first.agg(F.sum("n_target"), *[F.sum(f"with{i}") for i in range(len(water))]).first()
    seen = row[0] or 0
    kept = [i for i in range(len(water))
            if seen and 100.0 * (row[i + 1] or 0) / seen >= params.completeness_global]
    stations, sparse = first, first.limit(0)
    if kept:
        solid = total([F.when(F.col(f"all{i}") * F.lit(100.0) / F.col("n")
                              >= params.completeness_station, 1).otherwise(0) for i in kept])
        stations, sparse = (first.where(solid >= params.k_min_features),
                            first.where(solid < params.k_min_features))
    stations = stations.select(roles.station)
    wanted = set(feature_set)
    chosen = [water[i] for i in kept] + existing(df, extra)
    features = [f for f in chosen if f in wanted]
    columns = list(dict.fromkeys([*existing(df, roles.metadata), roles.target, *features]))
    rows = df.join(settle(stations), roles.station, "left_semi").select(*columns)
    lost = [water[i] for i in range(len(water)) if i not in kept]
    named = lambda table, stage: table.select(F.lit(stage).alias("stage"), F.lit("station").alias("kind"),
                                              F.col(roles.station).alias("name"))
    variables = df.sparkSession.createDataFrame([(2, "variable", v) for v in lost], "stage int, kind string, name string")
    dropped = (named(counts.where(F.col("n_target") < params.min_samples_target), 1)
               .unionByName(variables).unionByName(named(sparse, 3)))
    return RobustFilter(rows, stations.orderBy(roles.station), sorted(features), dropped)
