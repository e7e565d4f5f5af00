"""The base table: samples enriched with weather, basin and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.config import RAIN_FEATURES, SEASONAL_FEATURES, Roles
from rillwater.functions.dates import season_angle
from rillwater.operators.basins import inherit_rows, join_basins
from rillwater.operators.weather import join_by_date
from rillwater.plans.keep import settle_all


def add_season(df: DataFrame, date: str, names: Sequence[str] = SEASONAL_FEATURES) -> DataFrame:
    """Sine and cosine of the day of year."""
    angle = season_angle(F.col(date))
    return df.withColumns({names[0]: F.sin(angle), names[1]: F.cos(angle)})


def base_table(samples: DataFrame, rain: DataFrame, temperature: DataFrame,
               basins: DataFrame, inherited: DataFrame, roles: Roles,
               rain_names: Sequence[str] = RAIN_FEATURES) -> DataFrame:
    """Cleaned samples left-joined with daily features and basin attributes.

    Rain that was not recorded counts as none; ``rain_found`` tells the two apart.
    Both daily series have one row per day, so they are put side by side first and
    the samples are matched with days once. The result is not sorted: order matters
    only where folds are cut, and there it is made explicitly.
    """
    days = rain.withColumn("rain_found", F.lit(True)).join(temperature, roles.date, "full")
    fill = {c: 0.0 for c in rain_names} | {"rain_found": False}
    days, stations = settle_all(days, inherit_rows(basins, inherited, roles.station))
    return (
        samples
        .transform(join_by_date, days, roles, fill, settled=True)
        .transform(join_basins, stations, roles.station, settled=True)
        .transform(add_season, roles.date)
    )
