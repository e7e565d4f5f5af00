from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.functions import dates, keys, numbers
from rillwater.operators import cleaning

TEXTS = ["N/D", "5d", " 5 ", "inf", "NaN", "1e3", "-2.5", ".5", "5.", "", "1e999", None, "+7", "0x10"]
NUMBERS = [None, None, 5.0, None, None, 1000.0, -2.5, 0.5, 5.0, None, None, None, 7.0, None]


def test_only_finite_numbers_are_parsed(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.transform(cleaning.to_numeric, ["t", "absent"]).orderBy("i").collect()
    assert [r["t"] for r in rows] == NUMBERS


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r["x"] for r in df.transform(cleaning.to_numeric, ["x"]).collect()] == [None, None, 1.0]


def test_sentinels(spark):
    df = spark.createDataFrame([(t,) for t in ["N/D", " s/d ", "-", "  ", "", "-1", "n/d"]], "t string")
    assert [r["t"] for r in df.transform(cleaning.blank_sentinels).collect()] == [
        None, None, None, None, None, "-1", "n/d"]


def test_names_are_normalised_and_may_not_collide(spark):
    df = spark.createDataFrame([(1, 2)], ["Temp (°C)", "_O2 mg/l_"])
    assert df.transform(cleaning.normalize_columns).columns == ["temp_c", "o2_mg_l"]
    with pytest.raises(ValueError, match="collide"):
        spark.createDataFrame([(1, 2)], ["a b", "A_B"]).transform(cleaning.normalize_columns)


def test_first_matching_column_is_renamed(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["x", "la_fecha", "fecha_b"])
    assert df.transform(cleaning.rename_containing, "fecha", "date").columns == ["x", "date", "fecha_b"]
    with pytest.raises(ValueError):
        cleaning.find_column(df, "heliofania")


def test_serial_dates_with_fractions(spark):
    df = spark.createDataFrame([(36526.25,), (1.0,), (None,), (1e12,)], "d double")
    assert [r["d"] for r in df.transform(cleaning.parse_dates, "d").collect()] == [
        datetime(2000, 1, 1, 6), datetime(1899, 12, 31), None, None]


def test_text_dates_may_hold_serials(spark):
    df = spark.createDataFrame([("2000-02-29",), ("36526",), ("31/12/1999",), ("bad",), (None,)], "d string")
    assert [r["d"] for r in df.transform(cleaning.parse_dates, "d", ["dd/MM/yyyy"]).collect()] == [
        datetime(2000, 2, 29), datetime(2000, 1, 1), datetime(1999, 12, 31), None, None]


def test_missing_date_column_only_warns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.warns(UserWarning):
        assert cleaning.parse_dates(df, "date").columns == ["x"]


def test_empty_columns_then_empty_rows_go(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, None), (2, None, None)],
                               "x int, e string, t string")
    kept = cleaning.drop_empty(df)
    assert kept.columns == ["x", "t"] and kept.count() == 2


def test_sparse_columns_go_but_keys_stay(spark):
    df = spark.createDataFrame([(None, 1, None)] * 3 + [("s", 1, 2)], "station_code string, x int, y int")
    assert cleaning.drop_sparse(df, 0.5, ["station_code"]).columns == ["station_code", "x"]
    # The limit itself is still allowed.
    assert cleaning.drop_sparse(df, 0.75).columns == ["station_code", "x", "y"]


def test_required_columns(spark):
    roles = Roles()
    with pytest.raises(ValueError, match="date"):
        cleaning.require_columns(spark.createDataFrame([("a",)], "station_code string"), roles)
    empty = spark.createDataFrame([("a", None)], "station_code string, date timestamp_ntz")
    with pytest.warns(UserWarning):
        cleaning.require_columns(empty, roles)


def test_first_prefix_rule_wins(spark):
    codes = ["MN1", "MO1", "AMO0", "LP1", "P1", "99", "X", " mo2 ", "CDCN1", "TO9"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(keys.basin_of(F.col("c"))).collect()] == [
        "Arroyo Miguelete", "Arroyo Molino", "Arroyo Molino", "Arroyo Las Piedras", "Arroyo Pantanoso",
        "Sin Clasificar", "Otras Cuencas", "Arroyo Molino", "Arroyo Carrasco", "Arroyo Carrasco"]


def test_season_closes_the_year(spark):
    days = ["2000-12-31", "2001-12-31", "2000-02-29", "2001-01-01"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").select(
        "i", F.col("d").cast("timestamp_ntz").alias("d"))
    angle = [r[0] for r in df.orderBy("i").select(dates.season_angle(F.col("d"))).collect()]
    turn = 6.283185307179586
    assert angle[0] == pytest.approx(turn) and angle[1] == pytest.approx(turn)
    assert angle[2] == pytest.approx(turn * 60 / 366) and angle[3] == pytest.approx(turn / 365)


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 4.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(numbers.row_mean(["a", "b"])).collect()] == [2.0, 4.0, None]


def test_rounding_is_half_up_and_steady(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.6749999999999994,), (1e300,), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.round_to(F.col("x"), 2)).collect()] == [
        0.13, 1.01, 2.68, 1e300, None]


def test_rounding_leaves_whole_numbers(spark):
    df = spark.createDataFrame([(1, 1.23456789)], "i int, x double").transform(cleaning.round_numeric)
    assert tuple(df.first()) == (1, 1.2346) and df.schema["i"].dataType.simpleString() == "int"


def test_features_are_the_numeric_rest(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3.0)], "station_code string, n int, x double, target double")
    assert cleaning.infer_features(df, ["station_code", "target"]) == ["n", "x"]
