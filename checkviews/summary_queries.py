"""Descriptive statistics, completeness, sampling and correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checkviews.catalog import query, rounded
from checkviews.feature_queries import basin_table, summary_sql
from checkviews.views import EVENT_ROLES, ROLES, VARIABLES, r, sql, table, wq
from rillwater.operators import basins, correlation, summaries
from rillwater.operators.quantiles import exact_quantiles

_SUMMED = ("target", "v1", "v3", "v6")


@query("station_summary", sql("wq", summary_sql(_SUMMED, "wq")))
def station_summary(spark, sf_dir):
    return summaries.station_summary(wq(spark, sf_dir), ROLES, list(_SUMMED))


@query("station_summary_large_groups", sql("wq", summary_sql(_SUMMED, "wq")))
def station_summary_large_groups(spark, sf_dir):
    """The same report by the plan that ranks all distinct values."""
    return summaries.station_summary(wq(spark, sf_dir), ROLES, list(_SUMMED), strategy="ranked")


@query("station_summary_wide", sql("wq", f"""
SELECT station_code, count(v1) AS v1_n, {r('avg(v1)', 2)} AS v1_mean, {r('stddev_samp(v1)', 2)} AS v1_std,
 {r('min(v1)', 2)} AS v1_min, {r('quantile_cont(v1, 0.25)', 2)} AS v1_q1, {r('median(v1)', 2)} AS v1_median,
 {r('quantile_cont(v1, 0.75)', 2)} AS v1_q3, {r('max(v1)', 2)} AS v1_max FROM wq GROUP BY station_code"""))
def station_summary_wide(spark, sf_dir):
    long = summaries.station_summary(wq(spark, sf_dir), ROLES, ["v1"])
    return summaries.widen_summary(long, "station_code", ["v1"])


def _describe_sql(columns, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, " + ", ".join(f"{r(e)} AS {n}" for n, e in {
            "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
            "q1": f"quantile_cont({c}, 0.25)", "median": f"quantile_cont({c}, 0.5)",
            "q3": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}.items()) + f" FROM {source}"
        for c in columns)


@query("describe_numeric", sql("wq", _describe_sql(("target", *VARIABLES), "wq")))
def describe_numeric(spark, sf_dir):
    return rounded(summaries.describe_numeric(wq(spark, sf_dir).select("target", *VARIABLES)))


@query("exact_quantiles", sql("wq", " UNION ALL ".join(
    f"SELECT basin, '{c}' AS variable, {r(f'quantile_cont({c}, 0.01)')} AS p01,"
    f" {r(f'quantile_cont({c}, 0.9)')} AS p90, {r(f'quantile_cont({c}, 1.0)')} AS top FROM wq GROUP BY basin"
    for c in ("target", "v4"))))
def quantiles(spark, sf_dir):
    return rounded(exact_quantiles(wq(spark, sf_dir), ["basin"], ["target", "v4"],
                                   {"p01": 0.01, "p90": 0.9, "top": 1.0}))


_TEXTS = ("station_code", "basin", "raw_v1", "empty_text")


@query("describe_text", sql("wq", " UNION ALL ".join(
    f"""(SELECT '{c}' AS variable, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, count(value) AS n_distinct,
 first(value ORDER BY n DESC, value) AS top, first(n ORDER BY n DESC, value) AS freq
 FROM (SELECT {e} AS value, count(*) AS n FROM wq WHERE {e} IS NOT NULL GROUP BY 1))"""
    for c, e in zip(_TEXTS, ("station_code", "basin", "raw_v1",
                             "CASE WHEN l_partkey < 0 THEN basin END")))))
def describe_text(spark, sf_dir):
    rows = wq(spark, sf_dir).withColumnRenamed("empty", "empty_text")
    return summaries.describe_text(rows, _TEXTS)


_SHARES = ("target", *VARIABLES)


@query("completeness_global", sql("wq", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) AS n_rows, count({c}) AS n_values,"
    f" {r(f'count({c}) * 100.0 / count(*)')} AS present_pct,"
    f" {r(f'100 - count({c}) * 100.0 / count(*)')} AS missing_pct FROM wq" for c in _SHARES)))
def completeness_global(spark, sf_dir):
    return rounded(summaries.completeness(wq(spark, sf_dir), _SHARES))


@query("completeness_station", sql("wq", " UNION ALL ".join(
    f"SELECT station_code, '{c}' AS variable, count(*) AS n_rows, count({c}) AS n_values,"
    f" {r(f'count({c}) * 100.0 / count(*)')} AS present_pct,"
    f" {r(f'100 - count({c}) * 100.0 / count(*)')} AS missing_pct FROM wq GROUP BY station_code"
    for c in _SHARES)))
def completeness_station(spark, sf_dir):
    return rounded(summaries.completeness(wq(spark, sf_dir), _SHARES, ["station_code"]))


_MISSING = "missing AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, 100 - count({c}) * 100.0 / count(*) AS missing_pct FROM wq"
    for c in (*_SHARES, "station_code")) + ")"


@query("most_missing", sql("wq", _MISSING, f"""
SELECT variable, {r('missing_pct')} AS missing_pct FROM missing WHERE missing_pct < 100
ORDER BY missing_pct DESC, variable LIMIT 4"""))
def most_missing(spark, sf_dir):
    rows = wq(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    return rounded(summaries.most_missing(rows, [*_SHARES, "station_code", "nothing"], 4))


@query("least_missing", sql("wq", _MISSING, f"""
SELECT variable, {r('missing_pct')} AS missing_pct FROM missing WHERE missing_pct < 100
ORDER BY missing_pct, variable LIMIT 4"""))
def least_missing(spark, sf_dir):
    return rounded(summaries.most_missing(wq(spark, sf_dir), [*_SHARES, "station_code"], 4, least=True))


@query("viability_report", sql("wq", f"""
SELECT station_code, basin, count(*) AS total_muestras, count(target) AS muestras_con_target,
 {', '.join(f"{r(f'count({c}) * 100.0 / count(*)', 1)} AS {c}_pct_completo" for c in _SHARES)}
FROM wq GROUP BY station_code, basin"""))
def viability_report(spark, sf_dir):
    return summaries.viability_report(wq(spark, sf_dir), ROLES, VARIABLES)


@query("overview", sql("wq", """
SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
 count(DISTINCT station_code) AS n_stations, 'station_code, date' AS columns FROM wq"""))
def overview(spark, sf_dir):
    return summaries.overview(wq(spark, sf_dir).select("station_code", "date"), ROLES)


@query("counts_by_key", sql("wq", "SELECT basin, station_code, count(*) AS n_rows FROM wq GROUP BY ALL"))
def counts_by_key(spark, sf_dir):
    return summaries.counts_by(wq(spark, sf_dir), "basin", "station_code")


@query("distinct_sorted", sql("wq", "SELECT DISTINCT basin FROM wq"))
def distinct_sorted(spark, sf_dir):
    return summaries.distinct_sorted(wq(spark, sf_dir), "basin")


@query("station_difference", sql("wq basin", """
SELECT station_code FROM wq EXCEPT SELECT station_code FROM basin_wide"""))
def station_difference(spark, sf_dir):
    return basins.unmatched_stations(wq(spark, sf_dir), basin_table(spark, sf_dir))


def _frequency_sql(source, station, date):
    whole = f"CAST(floor(epoch_us({date} - lag({date}) OVER (PARTITION BY {station} ORDER BY {date})) / 86400000000.0) AS BIGINT)"
    return f"""gaps AS (SELECT {station}, {whole} AS gap FROM {source})""", f"""
SELECT {station}, count(*) AS n_muestras, {r('avg(gap)', 2)} AS frecuencia_media_dias,
 min(gap) AS frecuencia_min_dias, max(gap) AS frecuencia_max_dias FROM gaps GROUP BY {station}"""


@query("sampling_frequency", sql("wq", *_frequency_sql("wq", "station_code", "date")))
def sampling_frequency(spark, sf_dir):
    return summaries.sampling_frequency(wq(spark, sf_dir), ROLES)


_gaps, _events_query = _frequency_sql("events", "user_id", "ts")


@query("sampling_frequency_events", f"WITH {_gaps} {_events_query}")
def sampling_frequency_events(spark, sf_dir):
    return summaries.sampling_frequency(table(spark, sf_dir, "events"), EVENT_ROLES)


@query("sampling_gaps", f"""
WITH visits AS (SELECT user_id, ts, count(*) AS visits FROM events GROUP BY 1, 2)
SELECT user_id, ts, visits, CAST(floor(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts))
 / 86400000000.0) AS BIGINT) AS gap_days FROM visits""")
def sampling_gaps(spark, sf_dir):
    return summaries.sampling_gaps(table(spark, sf_dir, "events"), EVENT_ROLES)


@query("date_histogram", sql("wq", """edge AS (
 SELECT epoch_us(min(date)) AS lo, epoch_us(max(date)) AS hi FROM wq)""", """placed AS (
 SELECT least(CAST(floor((epoch_us(date) - lo) / CAST(hi - lo AS DOUBLE) * 50) AS BIGINT), 49) AS bin FROM wq, edge)""", """
SELECT b.bin, count(placed.bin) AS n FROM range(50) b(bin) LEFT JOIN placed USING (bin) GROUP BY b.bin"""))
def date_histogram(spark, sf_dir):
    return rounded(summaries.date_histogram(wq(spark, sf_dir), "date"))


@query("center_lines", sql("wq", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(f'avg({c})')} AS mean, {r(f'median({c})')} AS median FROM wq"
    for c in ("target", "v4"))))
def center_lines(spark, sf_dir):
    return rounded(summaries.center_lines(wq(spark, sf_dir), ["target", "v4"]))


@query("boxplot_stats", sql("wq basin", """placed AS (
 SELECT wq.station_code, wq.basin, b.basin_area_a, ln(1 + target) AS value FROM wq
 LEFT JOIN basin_wide b USING (station_code) WHERE target IS NOT NULL)""", """boxes AS (
 SELECT station_code, any_value(basin) AS basin, any_value(basin_area_a) AS area, count(*) AS n,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
 FROM placed GROUP BY station_code)""", """tails AS (
 SELECT p.station_code, min(CASE WHEN inside THEN value END) AS whisker_low,
  max(CASE WHEN inside THEN value END) AS whisker_high, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers
 FROM (SELECT placed.station_code, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM placed JOIN boxes USING (station_code)) p GROUP BY 1)""", f"""
SELECT station_code, basin, position, position > 0 AND basin IS DISTINCT FROM before AS new_basin, n,
 {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r('whisker_low')} AS whisker_low,
 {r('whisker_high')} AS whisker_high, n_outliers
FROM (SELECT *, row_number() OVER w - 1 AS position, lag(basin) OVER w AS before FROM boxes JOIN tails USING (station_code)
 WINDOW w AS (ORDER BY basin NULLS LAST, area NULLS LAST, station_code))"""))
def boxplot_stats(spark, sf_dir):
    rows = basins.join_basins(wq(spark, sf_dir), basin_table(spark, sf_dir))
    return rounded(summaries.boxplot(rows, ROLES, "target", "basin_area_a", log=True,
                                     strategy="ranked"))


_corr = lambda a, b: r(f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END", 6)
_CORRELATED = ("target", *VARIABLES, "fixed")


@query("correlation_matrix", sql("wq", "shown AS (SELECT *, CAST(1 AS DOUBLE) AS fixed FROM wq)", " UNION ALL ".join(
    f"SELECT '{b}' AS variable, '{a}' AS other, {_corr(b, a)} AS r FROM shown"
    for a, b in combinations(_CORRELATED, 2))))
def correlation_matrix(spark, sf_dir):
    rows = wq(spark, sf_dir).withColumn("fixed", F.lit(1.0))
    return rounded(correlation.correlation_matrix(rows, [*_CORRELATED, "basin"]), 6)


@query("target_correlation", sql("wq", "logged AS (SELECT *, ln(1 + target) AS y FROM wq)", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {_corr(c, 'y')} AS r FROM logged" for c in VARIABLES)))
def target_correlation(spark, sf_dir):
    return rounded(correlation.target_correlation(wq(spark, sf_dir), VARIABLES, "target"), 6)
