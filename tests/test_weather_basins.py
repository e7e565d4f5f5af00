from datetime import datetime, timedelta

import pandas as pd
import pytest

from rillwater.config import RAIN_FEATURES, Roles
from rillwater.operators import basins, weather

START = datetime(2020, 1, 1)


def series(spark, values):
    rows = [(START + timedelta(days=d), v) for d, v in values]
    return spark.createDataFrame(rows, "date timestamp_ntz, g double")


def test_windows_are_open_at_the_far_end(spark):
    # Gaps of exactly 3 and 7 days fall out of the 3- and 7-day windows.
    daily = series(spark, [(0, 1.0), (3, 2.0), (10, 4.0), (11, None), (12, 8.0)])
    rows = weather.rain_features(daily).orderBy("date").collect()
    mean, sum3, sum7, mean7 = RAIN_FEATURES
    assert [r[sum3] for r in rows] == [1.0, 2.0, 4.0, 4.0, 12.0]
    assert [r[sum7] for r in rows] == [1.0, 3.0, 4.0, 4.0, 12.0]
    assert [r[mean7] for r in rows] == [1.0, 1.5, 4.0, 4.0, 6.0]
    assert rows[3][mean] is None


@pytest.mark.parametrize("block", [4096, 20, 4])
def test_rolling_agrees_with_pandas(spark, monkeypatch, block):
    # Blocks may be shorter than the window.
    monkeypatch.setattr(weather, "BLOCK_DAYS", block)
    values = [(d, None if d % 7 == 3 else float(d * d % 17)) for d in range(60) if d % 5 != 1]
    got = weather.rolling(series(spark, values), "date", "g",
                          [("s", "sum", 3), ("m", "mean", 14)]).orderBy("date").toPandas()
    want = pd.Series([v for _, v in values],
                     index=[START + timedelta(days=d) for d, _ in values], dtype=float)
    pd.testing.assert_series_equal(got["s"], want.rolling("3D").sum().reset_index(drop=True), check_names=False)
    pd.testing.assert_series_equal(got["m"], want.rolling("14D").mean().reset_index(drop=True), check_names=False)


def test_days_become_unique_and_dateless_rows_go(spark):
    rows = [(START, 1.0), (START + timedelta(hours=5), 3.0), (None, 9.0)]
    daily = weather.one_row_per_day(spark.createDataFrame(rows, "date timestamp_ntz, g double"), "date", ["g"])
    assert [tuple(r) for r in daily.collect()] == [(START, 2.0)]


def test_join_needs_the_exact_instant(spark):
    roles = Roles()
    samples = spark.createDataFrame([("a", START), ("b", START + timedelta(hours=1)), ("c", None)],
                                    "station_code string, date timestamp_ntz")
    rain = spark.createDataFrame([(START, 5.0), (None, 7.0)], "date timestamp_ntz, rain double")
    rows = {r["station_code"]: (r["rain"], r["found"]) for r in
            weather.join_by_date(samples, rain, roles, {"rain": 0.0}, "found").collect()}
    assert rows == {"a": (5.0, True), "b": (0.0, False), "c": (0.0, False)}


def test_temperature_columns_are_found_by_name(spark):
    wide = spark.createDataFrame([("2020-01-01", "10", "20", "7.5"), ("2020-01-02", "s/d", "30", "x")],
                                 ["estacion_fecha", "a_temperatura media", "b_temperatura media", "heliofania_horas"])
    rows = weather.temperature_features(wide).orderBy("date").collect()
    assert [r["temp_ambiente_promedio"] for r in rows] == [15.0, 30.0]
    assert [r["temp_media_3d"] for r in rows] == [15.0, 22.5]
    assert [r["horas_sol"] for r in rows] == [7.5, None]


def test_last_statement_of_a_parameter_counts(spark):
    long = spark.createDataFrame([("S1", "area", 1.0, 1), ("S1", "slope", 5.0, 2), ("S1", "area", 2.0, 3),
                                  ("S2", "slope", None, 1)],
                                 "station_code string, Parameter string, Value double, line int")
    rows = basins.pivot_parameters(long, ["station_code"], "line").orderBy("station_code").collect()
    assert [tuple(r) for r in rows] == [("S1", 2.0, 5.0), ("S2", None, None)]


def test_only_absent_children_inherit(spark):
    table = spark.createDataFrame([("mo1 ", 1.0), ("LR1", 2.0)], "station_code string, area double")
    pairs = basins.inherited_map(spark, [("AMO0", "MO1"), ("LR1", "MO1"), ("LR2", "NONE")])
    rows = sorted(tuple(r) for r in basins.inherit_rows(table, pairs).collect())
    assert rows == [("AMO0", 1.0), ("LR1", 2.0), ("MO1", 1.0)]


def test_clashing_columns_get_the_suffix(spark):
    samples = spark.createDataFrame([(" s1", "b1"), ("s2", "b2")], "station_code string, basin string")
    table = spark.createDataFrame([("S1 ", "other", 3.0)], "station_code string, basin string, area double")
    rows = {r["station_code"]: (r["basin"], r["basin_cuenca"], r["area"])
            for r in basins.join_basins(samples, table).collect()}
    assert rows == {"S1": ("b1", "other", 3.0), "S2": ("b2", None, None)}
    assert [r[0] for r in basins.unmatched_stations(samples, table).collect()] == ["S2"]


def test_expected_stations_ignore_case(spark):
    expected = spark.createDataFrame([("s1",), ("S3",)], "station_code string")
    found = spark.createDataFrame([("S1",)], "station_code string")
    assert [r[0] for r in basins.missing_expected(expected, found).collect()] == ["S3"]


def test_assignment_figures(spark):
    rows = [("a", START, "x", "g"), ("a", START, "x", None), ("b", START, None, "g"), ("b", None, "y", "g")]
    df = spark.createDataFrame(rows, "station_code string, date timestamp_ntz, basin string, geometry string")
    found = {(r["check"], r["label"]): r["n"] for r in basins.assignment_check(df, Roles(), "geometry").collect()}
    assert found == {("rows", None): 4, ("rows_without_basin", None): 1, ("rows_without_geometry", None): 1,
                     ("repeated_visits", None): 1, ("rows_of_basin", "x"): 2, ("rows_of_basin", "y"): 1}


@pytest.mark.parametrize("hours, gap", [(24, 1), (42, 1), (48, 2), (23, 0)])
def test_whole_days_are_completed_ones(spark, hours, gap):
    from rillwater.operators.summaries import sampling_frequency
    df = spark.createDataFrame([("a", START + timedelta(hours=3)), ("a", START + timedelta(hours=3 + hours))],
                               "station_code string, date timestamp_ntz")
    row = sampling_frequency(df, Roles()).first()
    assert (row["n_muestras"], row["frecuencia_min_dias"], row["frecuencia_max_dias"]) == (2, gap, gap)
