"""Descriptive statistics, completeness and sampling reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.functions import numbers
from rillwater.functions.dates import whole_days
from rillwater.operators import cleaning
from rillwater.operators.ordering import row_index
from rillwater.operators.quantiles import exact_quantiles, percentile_array
from rillwater.plans.keep import settle, store

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                     by: Sequence[str] = (), strategy: str = "bracketed",
                     digits: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of each variable (and group)."""
    columns = cleaning.numeric_columns(df) if columns is None else cleaning.existing(df, columns)
    columns = [c for c in columns if c not in by]
    if not columns:
        raise ValueError("none of the variables exists")
    moments = []
    for i, c in enumerate(columns):
        moments += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"),
                    F.stddev_samp(c).alias(f"std{i}"),
                    F.min(c).cast("double").alias(f"min{i}"),
                    F.max(c).cast("double").alias(f"max{i}")]
        if strategy == "direct":
            moments.append(percentile_array(F.col(c), list(QUARTILES.values())).alias(f"q{i}"))
    wide = df.groupBy(*by).agg(*moments)
    parts = ["n", "mean", "std", "min", "max"]
    rows = F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{p}{i}").alias(p) for p in parts],
                 *([F.col(f"q{i}")[j].alias(q) for j, q in enumerate(QUARTILES)]
                   if strategy == "direct" else []))
        for i, c in enumerate(columns)
    ])
    long = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    if strategy != "direct":
        quartiles = exact_quantiles(df, by, columns, QUARTILES, strategy)
        renamed = quartiles.withColumnsRenamed({k: f"_{k}" for k in [*by, "variable"]})
        same = F.lit(True)
        for k in [*by, "variable"]:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        long = long.join(renamed, same, "left").drop(*[f"_{k}" for k in [*by, "variable"]])
    figures = ["mean", "std", "min", "q1", "median", "q3", "max"]
    shown = [numbers.round_to(F.col(f), digits).alias(f) if digits is not None else F.col(f)
             for f in figures]
    return long.select(*by, "variable", "n", *shown)


def station_summary(df: DataFrame, roles: Roles, variables: Sequence[str] | None = None,
                    digits: int = 2, strategy: str = "bracketed") -> DataFrame:
    """``describe_numeric`` per station, text variables read as numbers."""
    if variables is not None:
        df = df.transform(cleaning.to_numeric, variables)
    known = df.where(F.col(roles.station).isNotNull())
    return describe_numeric(known, variables, [roles.station], strategy, digits)


def widen_summary(summary: DataFrame, station: str, variables: Sequence[str]) -> DataFrame:
    """One row per station, columns ``<variable>_<statistic>``."""
    figures = [c for c in summary.columns if c not in (station, "variable")]
    return summary.groupBy(station).agg(*[
        F.max(F.when(F.col("variable") == v, F.col(f))).alias(f"{v}_{f}")
        for v in variables for f in figures])


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on ties), its count."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("r")).select("r.*")
    counted = cells.groupBy("variable", "value").agg(F.count("value").alias("n"))
    first = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("less"),
                                                              F.col("value").alias("value"))))
    return (counted.groupBy("variable")
            .agg(F.sum("n").alias("n"), F.count("value").alias("n_distinct"),
                 first.alias("first"))
            .select("variable", "n", "n_distinct", F.col("first.value").alias("top"),
                    (-F.col("first.less")).alias("freq")))


def completeness(df: DataFrame, columns: Sequence[str] | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Per variable (and group): rows, values, percentage present and missing."""
    columns = list(df.columns) if columns is None else list(columns)
    wide = df.groupBy(*by).agg(F.count("*").alias("n_rows"),
                               *[F.count(F.col(f"`{c}`")).alias(f"n{i}")
                                 for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n_values"))
                     for i, c in enumerate(columns)])
    share = F.col("n_values") * F.lit(100.0) / F.col("n_rows")
    return (wide.select(*by, "n_rows", F.explode(rows).alias("r"))
            .select(*by, "r.variable", "n_rows", "r.n_values")
            .where(F.col("n_rows") > 0)
            .withColumn("present_pct", share).withColumn("missing_pct", 100 - share))


def most_missing(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10,
                 least: bool = False) -> DataFrame:
    """The n variables with most (or least) missing cells, all-null ones left out."""
    table = completeness(df, columns).where(F.col("missing_pct") < 100)
    order = F.col("missing_pct").asc() if least else F.col("missing_pct").desc()
    return (table.orderBy(order, "variable").limit(n)
            .select("variable", "missing_pct").orderBy("missing_pct", "variable"))


def viability_report(df: DataFrame, roles: Roles, variables: Sequence[str]) -> DataFrame:
    """Per station: rows, rows with target, and completeness of each variable (1 decimal)."""
    pct = lambda c: numbers.round_to(F.count(c) * F.lit(100.0) / F.count("*"), 1)
    return (df.groupBy(roles.station, roles.basin)
            .agg(F.count("*").alias("total_muestras"),
                 F.count(roles.target).alias("muestras_con_target"),
                 *[pct(c).alias(f"{c}_pct_completo") for c in [roles.target, *variables]]))


def overview(df: DataFrame, roles: Roles, approximate: bool = False) -> DataFrame:
    """Rows, first and last date, number of stations, column names."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count("*").alias("n_rows"), F.min(roles.date).alias("first_date"),
                  F.max(roles.date).alias("last_date"),
                  distinct(F.col(roles.station)).alias("n_stations")) \
        .withColumn("columns", F.lit(", ".join(df.columns)))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return (df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows")))


def distinct_sorted(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).select(name).distinct().orderBy(name)


def _sampled_days(df: DataFrame, roles: Roles) -> DataFrame:
    """First, last and number of visits per station and calendar day.

    Two visits of one day are never a whole day apart, so this is all the gap
    statistics need, and it is combined map-side however often a station is seen.
    """
    known = df.where(F.col(roles.station).isNotNull())
    return known.groupBy(roles.station, F.to_date(roles.date).alias("day")).agg(
        F.min(roles.date).alias("first_visit"), F.max(roles.date).alias("last_visit"),
        F.count(roles.date).alias("visits"))


def _day_gaps(df: DataFrame, roles: Roles) -> DataFrame:
    # A window holds at most one row per calendar day of a station.
    order = Window.partitionBy(roles.station).orderBy("day")
    days = _sampled_days(df, roles)
    previous = F.lag("last_visit").over(order)
    return days.withColumn("gap", whole_days(previous, F.col("first_visit")))


def sampling_gaps(df: DataFrame, roles: Roles) -> DataFrame:
    """Per station and visited instant: visits, whole days since the visit before."""
    gaps = _day_gaps(df.where(F.col(roles.date).isNotNull()), roles).select(
        F.col(roles.station).alias("_station"), F.col("first_visit"), "gap")
    visits = (df.where(F.col(roles.date).isNotNull() & F.col(roles.station).isNotNull())
              .groupBy(roles.station, roles.date).agg(F.count("*").alias("visits")))
    first = (F.col(roles.station) == F.col("_station")) & (F.col(roles.date) == F.col("first_visit"))
    days = F.when(F.col("first_visit").isNull(), F.lit(0)).otherwise(F.col("gap"))
    return (visits.join(gaps, first, "left")
            .select(roles.station, roles.date, "visits", days.cast("bigint").alias("gap_days")))


def sampling_frequency(df: DataFrame, roles: Roles, digits: int = 2) -> DataFrame:
    """Per station: visits and mean, least and greatest gap in whole days."""
    gaps = _day_gaps(df, roles)
    within = F.when(F.col("visits") > 1, F.lit(0))
    return (gaps.groupBy(roles.station)
            .agg(F.sum("visits").alias("n_muestras"),
                 F.sum("gap").alias("total"),
                 F.min(F.least(F.col("gap"), within)).alias("low"),
                 F.max(F.greatest(F.col("gap"), within)).alias("high"))
            .select(roles.station, "n_muestras",
                    numbers.round_to(F.when(F.col("n_muestras") > 1, F.coalesce("total", F.lit(0))
                                            / (F.col("n_muestras") - 1)), digits)
                    .alias("frecuencia_media_dias"),
                    F.col("low").cast("bigint").alias("frecuencia_min_dias"),
                    F.col("high").cast("bigint").alias("frecuencia_max_dias")))


def date_histogram(df: DataFrame, date: str, bins: int = 50) -> DataFrame:
    """Rows per equal-width date bin; the last bin includes the last date."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"),
                              F.col(date).cast("timestamp_ntz"))
    low, high = df.agg(F.min(micros), F.max(micros)).first()
    if low is None:
        return df.select(F.lit(0).cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    span = max(high - low, 1)
    # Whole numbers in steps of at most span * bins would overflow for long series.
    place = F.floor((micros - F.lit(low)) / F.lit(float(span)) * bins)
    filled = (df.where(F.col(date).isNotNull())
              .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
              .agg(F.count("*").alias("n")))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").fillna({"n": 0})


def center_lines(df: DataFrame, variables: Sequence[str], strategy: str = "bracketed") -> DataFrame:
    """Mean and median of each variable, the reference lines of a series plot."""
    return (describe_numeric(df, variables, strategy=strategy)
            .select("variable", "mean", "median"))


def boxplot(df: DataFrame, roles: Roles, variable: str, area: str | None = None,
            log: bool = False, whisker: float = 1.5, strategy: str = "bracketed") -> DataFrame:
    """Box statistics per station in plot order (basin, then basin area).

    Position counts from zero; ``new_basin`` marks where a divider line goes.
    """
    value = F.log1p(F.col(variable)) if log else F.col(variable).cast("double")
    keep = [roles.station, roles.basin] + ([area] if area else [])
    # Several reports are made of these rows, so the joins behind them run once.
    rows = store(df.where(F.col(variable).isNotNull() & F.col(roles.station).isNotNull())
                 .select(*keep, value.alias("value")), "box-rows")
    rank = F.col(area) if area else F.lit(None).cast("double")
    # Grouped by basin first: the rows then meet a hash aggregate of plain numbers,
    # and the smallest (basin, area) is sought among a few rows per station.
    places = (rows.groupBy(roles.station, F.col(roles.basin).alias("basin"))
              .agg(F.min(rank).alias("area"), F.count("*").alias("n"))
              .groupBy(roles.station)
              .agg(F.min(F.struct("basin", "area")).alias("place"), F.sum("n").alias("n")))
    boxes = exact_quantiles(rows, [roles.station], ["value"], QUARTILES, strategy).drop("variable")
    fences = settle(places.join(boxes, roles.station).select(
        roles.station, F.col("place.basin").alias("basin"), F.col("place.area").alias("area"),
        "n", *QUARTILES,
        (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("low"),
        (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("high")))
    inside = F.col("value").between(F.col("low"), F.col("high"))
    tails = (rows.select(roles.station, "value")
             .join(fences.select(roles.station, "low", "high"), roles.station)
             .groupBy(roles.station)
             .agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
                  F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                  F.sum((~inside).cast("bigint")).alias("n_outliers")))
    placed = row_index(fences.join(tails, roles.station),
                       [F.col("basin").asc_nulls_last(), F.col("area").asc_nulls_last(),
                        F.col(roles.station)], "position")
    # Sorted by basin, so a new basin starts at the least position it has.
    starts = placed.groupBy("basin").agg(F.min("position").alias("start"))
    flagged = placed.join(starts.withColumnRenamed("basin", "_basin"),
                          F.col("basin").eqNullSafe(F.col("_basin")))
    new_basin = (F.col("position") == F.col("start")) & (F.col("position") > 0)
    return flagged.select(roles.station, "basin", "position", new_basin.alias("new_basin"), "n",
                          *QUARTILES, "whisker_low", "whisker_high", "n_outliers")
