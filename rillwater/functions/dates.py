"""Date expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spreadsheet day zero, and the serials of the years 1 and 9999.
SERIAL_EPOCH = "1899-12-30 00:00:00"
SERIAL_RANGE = (-693593.0, 2958465.0)


def from_serial(col: Column) -> Column:
    """Spreadsheet serial (days, fractions allowed) to a timestamp without zone."""
    days = col.cast("double")
    low, high = SERIAL_RANGE
    micros = F.round(days * F.lit(86400e6)).cast("bigint")
    seconds = (micros / F.lit(1000000)).cast("decimal(20,6)")
    stamp = F.lit(SERIAL_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.when(days.between(low, high), stamp)


def from_text(col: Column, formats: Sequence[str] = ()) -> Column:
    """ISO text, or the first of ``formats`` that fits; bad text becomes null."""
    tries = [F.trim(col).try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(F.trim(col), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def day_number(col: Column) -> Column:
    """Whole days since 1970-01-01, the ordering value of daily windows."""
    return F.datediff(col, F.lit("1970-01-01").cast("date"))


def season_angle(col: Column) -> Column:
    """Day of year as an angle; leap years have 366 steps."""
    year_days = F.dayofyear(F.make_date(F.year(col), F.lit(12), F.lit(31)))
    return F.lit(2 * math.pi) * F.dayofyear(col) / year_days


def whole_days(earlier: Column, later: Column) -> Column:
    """Completed 24-hour periods between two instants."""
    return F.timestamp_diff("DAY", earlier, later)
