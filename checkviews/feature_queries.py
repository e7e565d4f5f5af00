"""Weather features, basin table, base table, filters and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checkviews.catalog import query, rounded
from checkviews.views import (BASIN_PARAMETERS, GAUGES, KEY, ROLES, THERMOMETERS, VARIABLES,
                              basin_long, inherited, r, rain, sql, table, temperature, wq)
from rillwater.config import RAIN_FEATURES, RobustFilterParams
from rillwater.functions.numbers import row_mean, round_to
from rillwater.operators import basins, filters, outliers, summaries, weather
from rillwater.plans.keep import store
from rillwater.plans.base_table import add_season, base_table as build_base_table

_keys = ", ".join(KEY)
TEMP_NAMES = ("temp_mean", "temp_3d", "temp_7d", "temp_14d")


def _mean_sql(columns):
    filled = " + ".join(f"coalesce({c}, 0)" for c in columns)
    present = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in columns)
    return f"({filled}) / NULLIF({present}, 0)"


def _roll_sql(how, value, days):
    return (f"{how}({value}) OVER (ORDER BY date RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING"
            " AND CURRENT ROW)")


RAIN_DAILY = f"rain_mean AS (SELECT date, {_mean_sql(GAUGES)} AS m FROM rain)"
RAIN_ROLLED = f"""rain_features AS (SELECT date, m AS precipitacion_promedio_mm,
 {_roll_sql('sum', 'm', 3)} AS prec_acum_3d, {_roll_sql('sum', 'm', 7)} AS prec_acum_7d,
 {_roll_sql('avg', 'm', 7)} AS prec_media_7d FROM rain_mean)"""
TEMP_DAILY = f"temp_mean AS (SELECT date, sun, {_mean_sql(THERMOMETERS)} AS m FROM temp)"
TEMP_ROLLED = f"""temp_features AS (SELECT date, m AS temp_mean, sun AS horas_sol,
 {_roll_sql('avg', 'm', 3)} AS temp_3d, {_roll_sql('avg', 'm', 7)} AS temp_7d,
 {_roll_sql('avg', 'm', 14)} AS temp_14d FROM temp_mean)"""


def rain_table(spark, sf_dir):
    return weather.rain_features(rain(spark, sf_dir))


def temperature_table(spark, sf_dir):
    return weather.temperature_features(temperature(spark, sf_dir), stations=THERMOMETERS,
                                        sun="sun", names=TEMP_NAMES)


@query("row_mean", sql("rain", f"SELECT date, {r(_mean_sql(GAUGES))} AS mean FROM rain"))
def row_mean_query(spark, sf_dir):
    return rounded(rain(spark, sf_dir).select("date", row_mean(GAUGES).alias("mean")))


@query("rain_rolling", sql("rain", RAIN_DAILY, RAIN_ROLLED, "SELECT date, " + ", ".join(
    f"{r(c)} AS {c}" for c in RAIN_FEATURES) + " FROM rain_features"))
def rain_rolling(spark, sf_dir):
    return rounded(rain_table(spark, sf_dir))


@query("temperature_rolling", sql("temp", TEMP_DAILY, TEMP_ROLLED, "SELECT date, " + ", ".join(
    f"{r(c)} AS {c}" for c in (*TEMP_NAMES, "horas_sol")) + " FROM temp_features"))
def temperature_rolling(spark, sf_dir):
    return rounded(temperature_table(spark, sf_dir))


@query("series_rolling", f"""
WITH daily AS (SELECT event_type, date_trunc('day', ts) AS ts, avg(value) AS value FROM events
 WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT event_type, CAST(ts AS TIMESTAMP) AS ts, {r('value')} AS value,
 {r('sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)')} AS sum_3d,
 {r('avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)')} AS mean_7d
FROM daily""")
def series_rolling(spark, sf_dir):
    """Several sub-day series at once: reduced to days, then rolled per series."""
    daily = weather.one_row_per_day(table(spark, sf_dir, "events"), "ts", ["value"], ["event_type"])
    return rounded(weather.rolling(daily, "ts", "value",
                                   [("sum_3d", "sum", 3), ("mean_7d", "mean", 7)], ["event_type"]))


_angle = ("2 * pi() * dayofyear(date) / dayofyear(make_date(CAST(year(date) AS INTEGER), 12, 31))")


@query("seasonal", sql("wq", f"""
SELECT DISTINCT date, {r(f'sin({_angle})', 6)} AS seasonal_sin, {r(f'cos({_angle})', 6)} AS seasonal_cos FROM wq"""))
def seasonal(spark, sf_dir):
    days = wq(spark, sf_dir).select("date").distinct()
    return rounded(add_season(days, "date"), 6)


@query("weather_join", sql("wq rain", RAIN_DAILY, RAIN_ROLLED, f"""
SELECT {_keys}, {r('coalesce(prec_acum_3d, 0)')} AS prec_acum_3d, rain_features.date IS NOT NULL AS rain_found
FROM wq LEFT JOIN rain_features USING (date)"""))
def weather_join(spark, sf_dir):
    joined = weather.join_by_date(wq(spark, sf_dir), rain_table(spark, sf_dir), ROLES,
                                  {"prec_acum_3d": 0.0}, "rain_found")
    return joined.select(*KEY, round_to(F.col("prec_acum_3d"), 4).alias("prec_acum_3d"), "rain_found")


def samples(spark, sf_dir):
    """Samples with raw station codes, as they arrive."""
    rows = wq(spark, sf_dir)
    return rows.drop("station_code").withColumnRenamed("station_raw", "station_code")


def basin_table(spark, sf_dir, holes=True):
    return basins.pivot_parameters(basin_long(spark, sf_dir, holes), ["station_code", "basin"], "line",
                                   BASIN_PARAMETERS)


def enriched(spark, sf_dir):
    return build_base_table(samples(spark, sf_dir), rain_table(spark, sf_dir),
                            temperature_table(spark, sf_dir), basin_table(spark, sf_dir),
                            inherited(spark, sf_dir), ROLES)


ENRICHED = f"""enriched AS (
 SELECT wq.*, coalesce(precipitacion_promedio_mm, 0) AS precipitacion_promedio_mm,
  coalesce(prec_acum_3d, 0) AS prec_acum_3d, coalesce(prec_acum_7d, 0) AS prec_acum_7d,
  coalesce(prec_media_7d, 0) AS prec_media_7d, temp_mean, temp_3d, temp_7d, temp_14d, horas_sol,
  b.basin AS basin_cuenca, basin_area_a, drainage_density, mean_slope,
  sin({_angle}) AS seasonal_sin, cos({_angle}) AS seasonal_cos
 FROM wq LEFT JOIN rain_features USING (date) LEFT JOIN temp_features USING (date)
 LEFT JOIN basins b USING (station_code))"""
_BASE = ("wq rain temp inherited", RAIN_DAILY, RAIN_ROLLED, TEMP_DAILY, TEMP_ROLLED, ENRICHED)
_BASE_COLUMNS = (*RAIN_FEATURES, *TEMP_NAMES, "horas_sol", "basin_area_a", "drainage_density",
                 "mean_slope", "seasonal_sin", "seasonal_cos")


@query("base_table", sql(*_BASE, f"""
SELECT station_code, basin, basin_cuenca, date, {_keys}, {', '.join(f'{r(c)} AS {c}' for c in _BASE_COLUMNS)}
FROM enriched"""))
def base_table(spark, sf_dir):
    rows = enriched(spark, sf_dir)
    return rounded(rows.select("station_code", "basin", "basin_cuenca", "date", *KEY, *_BASE_COLUMNS)
                   .withColumn("l_extendedprice", F.col("l_extendedprice"))).withColumn(
        "l_linenumber", F.col("l_linenumber").cast("int"))


def summary_sql(columns, source="enriched", digits=2):
    parts = []
    for c in columns:
        figures = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
                   "q1": f"quantile_cont({c}, 0.25)", "median": f"quantile_cont({c}, 0.5)",
                   "q3": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}
        parts.append(f"SELECT station_code, '{c}' AS variable, count({c}) AS n, " + ", ".join(
            f"{r(e, digits)} AS {n}" for n, e in figures.items())
            + f" FROM {source} GROUP BY station_code")
    return " UNION ALL ".join(parts)


_FLAGSHIP = ("target", "v1", "v4", "prec_acum_7d", "temp_14d", "mean_slope")


@query("enriched_station_summary", sql(*_BASE, summary_sql(_FLAGSHIP)))
def enriched_station_summary(spark, sf_dir):
    """Raw samples, weather, basins and season joined, then summarised per station."""
    rows = store(enriched(spark, sf_dir).select("station_code", *_FLAGSHIP), "flagship-rows")
    return summaries.station_summary(rows, ROLES, list(_FLAGSHIP))


@query("basin_pivot", sql("basin_all", f"""
SELECT station_code, basin, {', '.join(f'{r(c)} AS {c}' for c in BASIN_PARAMETERS)} FROM basin_wide"""))
def basin_pivot(spark, sf_dir):
    long = basin_long(spark, sf_dir, holes=False)
    return rounded(basins.pivot_parameters(long, ["station_code", "basin"], "line",
                                           basins.parameter_names(long)))


@query("inherited_basins", sql("inherited", f"""
SELECT station_code, basin, {', '.join(f'{r(c)} AS {c}' for c in BASIN_PARAMETERS)} FROM basins"""))
def inherited_basins(spark, sf_dir):
    return rounded(basins.inherit_rows(basin_table(spark, sf_dir), inherited(spark, sf_dir)))


@query("basin_inner_join", sql("wq basin", """
SELECT basin_wide.station_code, basin_wide.basin AS basin_cuenca, count(*) AS n_rows
FROM wq JOIN basin_wide USING (station_code) GROUP BY 1, 2"""))
def basin_inner_join(spark, sf_dir):
    joined = basins.join_basins(samples(spark, sf_dir), basin_table(spark, sf_dir), how="inner")
    return joined.groupBy("station_code", "basin_cuenca").agg(F.count("*").alias("n_rows"))


@query("unmatched_stations", sql("wq basin", """
SELECT DISTINCT station_code FROM wq WHERE station_code NOT IN (SELECT station_code FROM basin_wide)"""))
def unmatched_stations(spark, sf_dir):
    return basins.unmatched_stations(samples(spark, sf_dir), basin_table(spark, sf_dir))


@query("missing_expected", sql("inherited", """
SELECT DISTINCT upper(child) AS station_code FROM inherited
WHERE child NOT IN (SELECT station_code FROM basin_wide)"""))
def missing_expected(spark, sf_dir):
    expected = inherited(spark, sf_dir).select(F.lower("child").alias("station_code"))
    return basins.missing_expected(expected, basin_table(spark, sf_dir))


@query("assignment_check", sql("wq basin", """joined AS (
 SELECT wq.station_code, wq.date, b.basin, mean_slope FROM wq LEFT JOIN basin_wide b USING (station_code))""", """
SELECT 'rows' AS "check", NULL AS label, count(*) AS n FROM joined
UNION ALL SELECT 'rows_without_basin', NULL, count(*) FROM joined WHERE basin IS NULL
UNION ALL SELECT 'rows_without_geometry', NULL, count(*) FROM joined WHERE mean_slope IS NULL
UNION ALL SELECT 'repeated_visits', NULL, count(*) - count(DISTINCT (station_code, date)) FROM joined
UNION ALL SELECT 'rows_of_basin', basin, count(*) FROM joined WHERE basin IS NOT NULL GROUP BY basin"""))
def assignment_check(spark, sf_dir):
    joined = basins.join_basins(samples(spark, sf_dir).drop("basin"), basin_table(spark, sf_dir))
    return basins.assignment_check(joined, ROLES, geometry="mean_slope")


_FEATURES = ("v1", "v2", "v3", "v4")
_COMPLETE = "target IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES)
MIN_ROWS = 215


@query("complete_cases", sql("wq", f"SELECT {_keys}, station_code, date FROM wq WHERE {_COMPLETE}"))
def complete_cases(spark, sf_dir):
    rows = filters.complete_cases(wq(spark, sf_dir), ROLES, [*_FEATURES, "not_there"])
    return rows.select(*KEY, "station_code", "date")


@query("min_station_rows", sql("wq", f"""full_rows AS (SELECT * FROM wq WHERE {_COMPLETE})""", f"""
SELECT {_keys}, station_code FROM full_rows WHERE station_code IN
 (SELECT station_code FROM full_rows GROUP BY station_code HAVING count(*) >= {MIN_ROWS})"""))
def min_station_rows(spark, sf_dir):
    rows = filters.complete_cases(wq(spark, sf_dir), ROLES, _FEATURES)
    return filters.min_station_rows(rows, ROLES, MIN_ROWS).select(*KEY, "station_code")


@query("membership", sql("wq basin", """
SELECT station_code, count(*) AS n_rows FROM wq WHERE station_code IN (SELECT station_code FROM basin_wide)
GROUP BY station_code"""))
def membership(spark, sf_dir):
    rows = filters.in_set(wq(spark, sf_dir), "station_code", basin_table(spark, sf_dir))
    return rows.groupBy("station_code").agg(F.count("*").alias("n_rows"))


_PER_STATION = f"""per_station AS (SELECT station_code, count(*) AS n_all,
 count(CASE WHEN {_COMPLETE} THEN 1 END) AS n_complete FROM wq GROUP BY station_code)"""


@query("filter_funnel", sql("wq", _PER_STATION, f"""
SELECT CAST(0 AS BIGINT) AS step, 'start' AS stage, CAST(sum(n_all) AS BIGINT) AS n_rows, count(*) AS n_stations FROM per_station
UNION ALL SELECT 1, 'complete_cases', CAST(sum(n_complete) AS BIGINT), count(CASE WHEN n_complete > 0 THEN 1 END) FROM per_station
UNION ALL SELECT 2, 'min_station_rows', CAST(coalesce(sum(CASE WHEN n_complete >= {MIN_ROWS} THEN n_complete END), 0) AS BIGINT),
 count(CASE WHEN n_complete >= {MIN_ROWS} THEN 1 END) FROM per_station"""))
def filter_funnel(spark, sf_dir):
    return rounded(filters.filter_funnel(wq(spark, sf_dir), ROLES, _FEATURES, MIN_ROWS))


@query("dropped_stations", sql("wq", _PER_STATION, f"""
SELECT CASE WHEN n_complete = 0 THEN 'complete_cases' ELSE 'min_station_rows' END AS stage, station_code
FROM per_station WHERE n_complete < {MIN_ROWS}"""))
def dropped_stations(spark, sf_dir):
    return filters.dropped_stations(wq(spark, sf_dir), ROLES, _FEATURES, MIN_ROWS)


ROBUST = RobustFilterParams(min_samples_target=545, completeness_global=50.0,
                            completeness_station=60.0, k_min_features=4)
_with_target = ", ".join(f"count(CASE WHEN target IS NOT NULL THEN {v} END) AS with_{v}" for v in VARIABLES)
_kept = " UNION ALL ".join(
    f"SELECT '{v}' AS variable FROM counts WHERE n_target >= {ROBUST.min_samples_target}"
    f" HAVING sum(with_{v}) * 100.0 / sum(n_target) >= {ROBUST.completeness_global}" for v in VARIABLES)
_solid = " + ".join(
    f"CASE WHEN '{v}' IN (SELECT variable FROM kept) AND all_{v} * 100.0 / n >= {ROBUST.completeness_station}"
    " THEN 1 ELSE 0 END" for v in VARIABLES)


@query("robust_filter", sql("wq", f"""counts AS (SELECT station_code, count(*) AS n, count(target) AS n_target,
 {', '.join(f'count({v}) AS all_{v}' for v in VARIABLES)}, {_with_target} FROM wq GROUP BY station_code)""",
    f"kept AS ({_kept})", f"""stations AS (SELECT station_code FROM counts
 WHERE n_target >= {ROBUST.min_samples_target} AND {_solid} >= {ROBUST.k_min_features})""", """
SELECT station_code, count(*) AS n_rows, count(target) AS n_target, count(v1) AS n_v1,
 (SELECT string_agg(variable, ', ' ORDER BY variable) FROM kept WHERE variable <> 'v2') AS features
FROM wq WHERE station_code IN (SELECT station_code FROM stations) GROUP BY station_code"""))
def robust_filter(spark, sf_dir):
    done = filters.robust_filter(wq(spark, sf_dir), ROLES, [v for v in VARIABLES if v != "v2"], ROBUST)
    return done.rows.groupBy("station_code").agg(
        F.count("*").alias("n_rows"), F.count("target").alias("n_target"),
        F.count("v1").alias("n_v1")).withColumn("features", F.lit(", ".join(done.features)))


@query("robust_filter_audit", sql("wq", f"""counts AS (SELECT station_code, count(*) AS n, count(target) AS n_target,
 {', '.join(f'count({v}) AS all_{v}' for v in VARIABLES)}, {_with_target} FROM wq GROUP BY station_code)""",
    f"kept AS ({_kept})", f"""
SELECT CAST(1 AS BIGINT) AS stage, 'station' AS kind, station_code AS name FROM counts WHERE n_target < {ROBUST.min_samples_target}
UNION ALL SELECT 2, 'variable', v FROM (SELECT unnest([{', '.join(f"'{v}'" for v in VARIABLES)}]) AS v)
 WHERE v NOT IN (SELECT variable FROM kept)
UNION ALL SELECT 3, 'station', station_code FROM counts
 WHERE n_target >= {ROBUST.min_samples_target} AND NOT {_solid} >= {ROBUST.k_min_features}"""))
def robust_filter_audit(spark, sf_dir):
    """Stations and variables that each stage of the robust filter takes out."""
    return rounded(filters.robust_filter(wq(spark, sf_dir), ROLES, list(VARIABLES), ROBUST).dropped)


_CHECKED = ("target", "v1", "v4", "v6")
_scale = lambda c: f"ln(1 + {c})" if c == "target" else c
_back = lambda c, e: f"exp({e}) - 1" if c == "target" else e


def _iqr_bounds_sql(m=1.5):
    return "bounds AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {_back(c, f'q1 - {m} * (q3 - q1)')} AS low, {_back(c, f'q3 + {m} * (q3 - q1)')} AS high"
        f" FROM (SELECT quantile_cont({_scale(c)}, 0.25) AS q1, quantile_cont({_scale(c)}, 0.75) AS q3 FROM wq)"
        for c in _CHECKED) + ")"


def _mad_bounds_sql(t=1.2):
    parts = []
    for c in _CHECKED:
        x = _scale(c)
        parts.append(
            f"SELECT '{c}' AS variable,"
            f" min(CASE WHEN 0.6745 * ({x} - m) / mad >= -{t} THEN {c} END) AS low,"
            f" max(CASE WHEN 0.6745 * ({x} - m) / mad <= {t} THEN {c} END) AS high FROM wq,"
            f" (SELECT median(abs({x} - m)) AS mad, any_value(m) AS m"
            f" FROM wq, (SELECT median({x}) AS m FROM wq))")
    return "bounds AS (" + " UNION ALL ".join(parts) + ")"


def _treated_sql(bounds, strategy):
    parts = []
    for c in _CHECKED:
        new = (f"CASE WHEN {c} BETWEEN low AND high THEN {c} END" if strategy == "remove"
               else f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, low), high) END")
        parts.append(f"SELECT '{c}' AS variable, count(x) AS n, {r('avg(x)')} AS mean, {r('min(x)')} AS min,"
                     f" {r('max(x)')} AS max FROM (SELECT {new} AS x FROM wq, bounds WHERE variable = '{c}')")
    return sql("wq", bounds, " UNION ALL ".join(parts))


def _treated(spark, sf_dir, method, strategy, threshold=1.2, quantiles="bracketed"):
    rows = outliers.treat_outliers(wq(spark, sf_dir), _CHECKED, method, strategy, ["target"],
                                   threshold=threshold, quantiles=quantiles)
    wide = rows.agg(*[e.alias(f"{c}_{n}") for c in _CHECKED for n, e in (
        ("n", F.count(c)), ("mean", F.avg(c)), ("min", F.min(c)), ("max", F.max(c)))])
    return rounded(wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}_{n}").alias(n)
                                               for n in ("n", "mean", "min", "max")])
        for c in _CHECKED])).alias("row")).select("row.*"))


@query("outliers_iqr_remove", _treated_sql(_iqr_bounds_sql(), "remove"))
def outliers_iqr_remove(spark, sf_dir):
    return _treated(spark, sf_dir, "iqr", "remove")


@query("outliers_iqr_winsorize", _treated_sql(_iqr_bounds_sql(), "winsorize"))
def outliers_iqr_winsorize(spark, sf_dir):
    return _treated(spark, sf_dir, "iqr", "winsorize", quantiles="ranked")


@query("outliers_mad_remove", _treated_sql(_mad_bounds_sql(), "remove"))
def outliers_mad_remove(spark, sf_dir):
    return _treated(spark, sf_dir, "mad", "remove")


@query("outliers_mad_winsorize", _treated_sql(_mad_bounds_sql(), "winsorize"))
def outliers_mad_winsorize(spark, sf_dir):
    return _treated(spark, sf_dir, "mad", "winsorize", quantiles="ranked")


@query("outlier_bounds", sql("wq", _iqr_bounds_sql(), f"""
SELECT variable, {r('low')} AS low, {r('high')} AS high FROM bounds"""))
def outlier_bounds(spark, sf_dir):
    rows = wq(spark, sf_dir)
    return rounded(outliers.bounds_table(rows, outliers.outlier_bounds(
        rows, _CHECKED, "iqr", ["target"])))


@query("outlier_flags", sql("wq", _iqr_bounds_sql(), f"""
SELECT station_code, {', '.join(f"count(CASE WHEN {c} < (SELECT low FROM bounds WHERE variable = '{c}') OR {c} > (SELECT high FROM bounds WHERE variable = '{c}') THEN 1 END) AS {c}_out" for c in _CHECKED)}
FROM wq GROUP BY station_code"""))
def outlier_flags(spark, sf_dir):
    rows = wq(spark, sf_dir)
    flagged = outliers.flag_outliers(rows, outliers.outlier_bounds(rows, _CHECKED, "iqr", ["target"]))
    return flagged.groupBy("station_code").agg(*[
        F.count(F.when(F.col(f"{c}_is_outlier"), 1)).alias(f"{c}_out") for c in _CHECKED])
