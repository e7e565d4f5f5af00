import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwater.config import RobustFilterParams, Roles
from rillwater.operators import correlation, filters, outliers, quantiles, summaries

START = datetime(2020, 1, 1)
ROLES = Roles(target="y", features=("a", "b"))


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows; a constant, an empty and a tied column."""
    rng = np.random.default_rng(7)
    n = 9000
    group = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 40, n))
    frame = pd.DataFrame({
        "g": [None if g == 39 else f"g{g}" for g in group], "x": rng.lognormal(3, 2, n),
        "ties": rng.integers(0, 3, n).astype(float), "flat": 7.0})
    frame.loc[rng.random(n) < 0.2, "x"] = np.nan
    frame.loc[frame["g"] == "g5", "x"] = np.nan
    df = spark.createDataFrame(frame.astype({"x": object}).where(frame.notna(), None),
                               "g string, x double, ties double, flat double")
    return frame, df.cache()


PROBS = {"p0": 0.0, "p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("strategy", ["direct", "ranked", "bracketed"])
def test_quantiles_by_group_equal_pandas(skewed, strategy):
    frame, df = skewed
    found = quantiles.exact_quantiles(df, ["g"], ["x", "ties", "flat"], PROBS, strategy).collect()
    assert len(found) == 3 * frame["g"].nunique(dropna=False)
    for r in found:
        values = frame[frame["g"].isna() if r["g"] is None else frame["g"] == r["g"]][r["variable"]].dropna()
        for name, p in PROBS.items():
            if values.empty:
                assert r[name] is None
            else:
                assert r[name] == pytest.approx(values.quantile(p), rel=1e-12)


@pytest.mark.parametrize("strategy", ["direct", "ranked", "bracketed"])
def test_quantiles_of_everything_equal_pandas(skewed, strategy):
    frame, df = skewed
    for r in quantiles.exact_quantiles(df, (), ["x", "ties"], PROBS, strategy).collect():
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(frame[r["variable"]].quantile(p), rel=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 12, 99, 601])
def test_small_groups_keep_their_ranks(spark, n):
    df = spark.range(n).select(F.lit("k").alias("g"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    row = quantiles.exact_quantiles(df, ["g"], ["x"], {"p90": 0.9, "p10": 0.1}).first()
    want = pd.Series([float(i * i) for i in range(n)])
    assert row["p90"] == pytest.approx(want.quantile(0.9)) and row["p10"] == pytest.approx(want.quantile(0.1))


@pytest.mark.parametrize("margins", [((2000, 0.002), (100, 0.021)), ((5, 0.0),), ((-1, 0.0),)])
def test_bounds_that_miss_a_rank_are_made_good(skewed, margins):
    """Without a margin the bounds hold one of two neighbouring ranks at most; groups of any size stay exact."""
    frame, df = skewed
    found = quantiles._bracketed(df, ["g"], ["x", "ties", "flat"], PROBS, 20, margins).collect()
    assert len(found) == 3 * frame["g"].nunique(dropna=False)
    for r in found:
        values = frame[frame["g"].isna() if r["g"] is None else frame["g"] == r["g"]][r["variable"]].dropna()
        for name, p in PROBS.items():
            assert r[name] is None if values.empty else r[name] == pytest.approx(values.quantile(p), rel=1e-12)
    for r in quantiles._bracketed(df, (), ["x", "ties"], PROBS, 20, margins).collect():
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(frame[r["variable"]].quantile(p), rel=1e-12)


def test_few_values_outlive_the_bounds(spark):
    """Most of 200,000 values are counted in their gap, not kept."""
    df = spark.range(200_000).select((F.hash("id") / 7).alias("x"))
    limits = quantiles._bounds(df, (), ["x"], [0.25, 0.5, 0.75], quantiles.ACCURACY, quantiles.MARGINS).first()["_b0"]
    held = quantiles._long(df, (), ["x"], [F.array(*[F.lit(v) for v in limits])], 3).where("_gap is null and _value is not null").count()
    assert 3 * 0.002 * 200_000 < held < 3 * 0.008 * 200_000


def test_values_that_are_not_numbers_come_last(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("x"))
    for plan in ("ranked", "bracketed"):
        row = quantiles.exact_quantiles(df, (), ["x"], {"low": 0.0, "middle": 0.25, "top": 1.0}, plan).first()
        assert (row["low"], row["middle"]) == (1.0, 1125.5) and math.isnan(row["top"])


def test_groups_without_values_and_unknown_plans(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "g string, x double")
    got = {r["g"]: r["m"] for r in quantiles.exact_quantiles(df, ["g"], ["x"], {"m": 0.5}).collect()}
    assert got == {"a": 1.0, "b": None, None: 3.0}
    none = quantiles.exact_quantiles(df.limit(0), (), ["x"], {"m": 0.5}).collect()
    assert [(r["variable"], r["m"]) for r in none] == [("x", None)]
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, ["g"], ["x"], {"m": 0.5}, "auto")


@pytest.mark.parametrize("strategy", ["direct", "ranked", "bracketed"])
def test_summary_of_one_and_no_values(spark, strategy):
    df = spark.createDataFrame([("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)], "station_code string, y double")
    rows = {r["station_code"]: r for r in summaries.station_summary(df, Roles(target="y"), ["y"], strategy=strategy).collect()}
    assert rows["one"]["n"] == 1 and rows["one"]["std"] is None and rows["one"]["median"] == 5.0
    assert rows["none"]["n"] == 0 and rows["none"]["mean"] is None and rows["none"]["q1"] is None
    assert rows["two"]["std"] == 0.71 and rows["two"]["q3"] == 1.75


def test_unknown_variables_are_refused(spark):
    with pytest.raises(ValueError):
        summaries.describe_numeric(spark.createDataFrame([("a",)], "t string"), ["x"])


def test_text_description_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "t string, e string")
    rows = {r["variable"]: tuple(r)[1:] for r in summaries.describe_text(df, ["t", "e"]).collect()}
    assert rows == {"t": (4, 2, "a", 2), "e": (0, 0, None, None)}


def test_sampling_gaps_with_repeats(spark):
    times = [0, 1, 1, 30, 31, 80]  # hours
    df = spark.createDataFrame([("a", START + timedelta(hours=h)) for h in times] + [("b", START), ("c", None)],
                               "station_code string, date timestamp_ntz")
    rows = {r["station_code"]: tuple(r)[1:] for r in summaries.sampling_frequency(df, ROLES).collect()}
    diffs = pd.Series([START + timedelta(hours=h) for h in times]).diff().dt.days.dropna()
    assert rows["a"] == (6, round(diffs.mean(), 2), diffs.min(), diffs.max())
    assert rows["b"] == (1, None, None, None) and rows["c"] == (0, None, None, None)
    gaps = {r["date"]: (r["visits"], r["gap_days"]) for r in summaries.sampling_gaps(df, ROLES).where("station_code = 'a'").collect()}
    assert gaps[START] == (1, None) and gaps[START + timedelta(hours=1)] == (2, 0)
    assert gaps[START + timedelta(hours=30)] == (1, 1) and gaps[START + timedelta(hours=80)] == (1, 2)


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(START + timedelta(days=d),) for d in (0, 1, 5, 10)] + [(None,)], "date timestamp_ntz")
    rows = {r["bin"]: r["n"] for r in summaries.date_histogram(df, "date", 10).collect()}
    assert rows == {b: {0: 1, 1: 1, 5: 1, 9: 1}.get(b, 0) for b in range(10)}
    same = spark.createDataFrame([(START,), (START,)], "date timestamp_ntz")
    assert sum(r["n"] for r in summaries.date_histogram(same, "date", 5).collect()) == 2
    assert summaries.date_histogram(df.where("false"), "date").count() == 0


def test_completeness_of_nothing(spark):
    df = spark.createDataFrame([], "a double")
    assert summaries.completeness(df).count() == 0


def test_correlation_guards(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.normal(size=(500, 3)) + 1e6, columns=["a", "b", "c"])
    frame.loc[rng.random(500) < 0.3, "a"] = np.nan
    frame.loc[frame["a"].notna(), "c"] = 3.3  # constant wherever a is present
    frame["flat"] = 0.1
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, flat double")
    found = {(r["variable"], r["other"]): r["r"] for r in
             correlation.correlation_matrix(df, ["a", "b", "c", "flat", "absent"]).collect()}
    assert len(found) == 6
    assert found["b", "a"] == pytest.approx(frame["a"].corr(frame["b"]), abs=1e-9)
    assert found["c", "b"] == pytest.approx(frame["b"].corr(frame["c"]), abs=1e-9)
    assert found["c", "a"] is None and found["flat", "a"] is None and found["flat", "b"] is None


def test_correlation_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [r["r"] for r in correlation.correlation_matrix(df, ["a", "b"]).collect()] == [None]


@pytest.mark.parametrize("quantile_plan", ["direct", "ranked", "bracketed"])
def test_outlier_rules(spark, quantile_plan):
    df = spark.createDataFrame([(float(x), 5.0, None) for x in [*range(20), 1000]] + [(None, 5.0, None)],
                               "x double, flat double, empty double")
    iqr = outliers.outlier_bounds(df, ["x", "flat", "empty"], "iqr", strategy=quantile_plan)
    assert iqr == {"x": (-10.0, 30.0), "flat": (5.0, 5.0)}
    mad = outliers.outlier_bounds(df, ["x", "flat", "empty"], "mad", strategy=quantile_plan)
    assert mad == {"x": (0.0, 19.0)}  # constant and empty columns have no bounds
    removed = outliers.treat_outliers(df, ["x"], quantiles=quantile_plan)
    assert removed.where("x is null").count() == 2 and removed.count() == 22
    flat = outliers.treat_outliers(df, ["x"], strategy="winsorize", quantiles=quantile_plan)
    assert flat.agg(F.max("x")).first()[0] == 30.0 and flat.where("x is null").count() == 1


def test_log_columns_are_judged_on_their_own_scale(spark):
    values = [float(10 ** (i % 5)) for i in range(50)] + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "y double")
    low, high = outliers.outlier_bounds(df, ["y"], "iqr", ["y"])["y"]
    logs = np.log1p(values)
    q1, q3 = np.quantile(logs, [0.25, 0.75])
    assert (low, high) == (pytest.approx(math.expm1(q1 - 1.5 * (q3 - q1))), pytest.approx(math.expm1(q3 + 1.5 * (q3 - q1))))


def test_unknown_outlier_settings_change_nothing(spark):
    df = spark.createDataFrame([(1.0,), (99.0,)], "x double")
    with pytest.warns(UserWarning):
        assert outliers.treat_outliers(df, ["x"], "other").collect() == df.collect()
    with pytest.warns(UserWarning):
        assert outliers.treat_outliers(df, ["x"], "iqr", "other").collect() == df.collect()


def wide(spark):
    rows = []
    for s, n, holes in (("full", 6, 0), ("exact", 4, 0), ("few", 2, 0), ("gappy", 6, 5)):
        rows += [(s, "b", START, 1.0, None if i < holes else 1.0, 2.0) for i in range(n)]
    rows.append(("full", "b", START, None, 1.0, 2.0))
    return spark.createDataFrame(rows, "station_code string, basin string, date timestamp_ntz, y double, a double, b double")


def test_station_minimum_is_inclusive(spark):
    df = filters.complete_cases(wide(spark), ROLES, ["a", "b", "absent"])
    kept = filters.min_station_rows(df, ROLES, 4).groupBy("station_code").count().collect()
    assert {r[0]: r[1] for r in kept} == {"full": 6, "exact": 4}
    assert filters.min_station_rows(df, ROLES, 0) is df


def test_funnel_and_dropped_agree_with_the_filters(spark):
    df = wide(spark)
    steps = [(r["n_rows"], r["n_stations"]) for r in filters.filter_funnel(df, ROLES, ["a", "b"], 4).orderBy("step").collect()]
    assert steps == [(19, 4), (13, 4), (10, 2)]
    assert sorted(tuple(r) for r in filters.dropped_stations(df, ROLES, ["a", "b"], 4).collect()) == [
        ("min_station_rows", "few"), ("min_station_rows", "gappy")]


def test_robust_filter_stages(spark):
    params = RobustFilterParams(4, 50.0, 50.0, 2)
    done = filters.robust_filter(wide(spark), ROLES, ["a", "b"], params)
    assert [r[0] for r in done.stations.collect()] == ["exact", "full"] and done.features == ["a", "b"]
    assert done.rows.count() == 11  # the row without target stays
    assert done.rows.columns == ["station_code", "basin", "date", "y", "a", "b"]
    none = filters.robust_filter(wide(spark), ROLES, ["a"], RobustFilterParams(99, 50.0, 50.0, 2))
    assert none.rows.count() == 0 and none.stations.count() == 0
    # No variable passes stage two: stage three is skipped.
    loose = filters.robust_filter(wide(spark), ROLES, ["a"], RobustFilterParams(4, 101.0, 50.0, 2))
    assert [r[0] for r in loose.stations.collect()] == ["exact", "full", "gappy"] and loose.features == []


def test_row_guard(spark):
    assert filters.enough_rows(spark.range(20), 20) and not filters.enough_rows(spark.range(19), 20)
