"""Daily weather series: station mean, rolling features, join to samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwater.config import RAIN_FEATURES, SOLAR_FEATURES, TEMP_FEATURES, Roles
from rillwater.functions.dates import day_number
from rillwater.functions.numbers import row_mean
from rillwater.operators import cleaning
from rillwater.plans.keep import settle

# (output column, aggregate, days including the current one)
Rolling = tuple[str, str, int]
# Days per window block, about eleven years.
BLOCK_DAYS = 4096


def one_row_per_day(df: DataFrame, date: str, values: Sequence[str],
                    series: Sequence[str] = ()) -> DataFrame:
    """Reduce a series to calendar days by mean; rows without a date are dropped."""
    day = F.date_trunc("DAY", F.col(date)).cast("timestamp_ntz").alias(date)
    return (df.where(F.col(date).isNotNull())
            .groupBy(*series, day)
            .agg(*[F.avg(c).alias(c) for c in values]))


def rolling(df: DataFrame, date: str, value: str, specs: Sequence[Rolling],
            series: Sequence[str] = ()) -> DataFrame:
    """Time-window aggregates over the last days, open at the far end.

    Needs one row per series and day. The calendar is cut into blocks, so that one
    long series is no single task; a day also joins the later blocks whose windows
    reach back to it, and each block answers for its own days only.
    """
    functions = {"sum": F.sum, "mean": F.avg}
    reach = max(days for _, _, days in specs) - 1
    block_of = lambda day: F.floor(day / F.lit(BLOCK_DAYS))
    placed = (df.withColumn("_day", day_number(F.col(date)))
              .withColumn("_block", F.explode(F.sequence(block_of(F.col("_day")),
                                                         block_of(F.col("_day") + reach)))))
    ordered = Window.partitionBy(*series, "_block").orderBy("_day")
    return (placed.withColumns({
        name: functions[how](value).over(ordered.rangeBetween(-(days - 1), Window.currentRow))
        for name, how, days in specs})
        .where(F.col("_block") == block_of(F.col("_day"))).drop("_day", "_block"))


def rain_features(wide: DataFrame, date: str = "date", gauges: Sequence[str] | None = None,
                  names: Sequence[str] = RAIN_FEATURES) -> DataFrame:
    """Mean over the gauges, 3- and 7-day sums and 7-day mean, one row per day."""
    gauges = [c for c in wide.columns if c != date] if gauges is None else list(gauges)
    mean, sum3, sum7, mean7 = names
    daily = (wide.transform(one_row_per_day, date, gauges)
             .select(date, row_mean(gauges).alias(mean)))
    return rolling(daily, date, mean, [(sum3, "sum", 3), (sum7, "sum", 7), (mean7, "mean", 7)])


def temperature_features(wide: DataFrame, date: str = "date", *,
                         stations: Sequence[str] | None = None, sun: str | None = None,
                         names: Sequence[str] = TEMP_FEATURES,
                         sun_name: str = SOLAR_FEATURES[0]) -> DataFrame:
    """Mean temperature with 3-, 7- and 14-day means, and hours of sun, per day.

    Without explicit columns they are found by name: dates contain ``fecha``,
    temperatures ``temperatura media`` and sunshine ``heliofania``.
    """
    if date not in wide.columns:
        wide = wide.transform(cleaning.rename_containing, "fecha", date)
        wide = wide.transform(cleaning.parse_dates, date)
    stations = ([c for c in wide.columns if "temperatura media" in c]
                if stations is None else list(stations))
    sun = cleaning.find_column(wide, "heliofania") if sun is None else sun
    mean, mean3, mean7, mean14 = names
    daily = (wide.transform(cleaning.to_numeric, [*stations, sun])
             .transform(one_row_per_day, date, [*stations, sun])
             .select(date, row_mean(stations).alias(mean), F.col(sun).alias(sun_name)))
    return rolling(daily, date, mean,
                   [(mean3, "mean", 3), (mean7, "mean", 7), (mean14, "mean", 14)])


def join_by_date(samples: DataFrame, weather: DataFrame, roles: Roles,
                 fill: Mapping[str, object] | None = None, found: str | None = None,
                 settled: bool = False) -> DataFrame:
    """Left join on the exact instant. ``weather`` has one row per day.

    ``fill`` replaces nulls afterwards (no rain record counts as no rain);
    ``found`` names a flag column that tells filled from recorded values.
    ``settled`` says that the table has been measured already.
    """
    if found:
        weather = weather.withColumn(found, F.lit(True))
    joined = samples.join(weather if settled else settle(weather), roles.date, "left")
    if found:
        joined = joined.fillna({found: False})
    return joined.transform(cleaning.fill_constants, fill) if fill else joined
