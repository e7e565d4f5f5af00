"""Order, folds, scores, comparisons and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checkviews.catalog import query, rounded
from checkviews.feature_queries import basin_table
from checkviews.views import (BASIN_PARAMETERS, KEY, ROLES, VARIABLES, fold_results,
                              predictions, r, scores_sql, sql, table, wq)
from rillwater.config import SCORE_COLUMNS
from rillwater.functions.numbers import round_to
from rillwater.operators import ordering, reports, scaling
from rillwater.sources import sinks

_keys = ", ".join(KEY)
_ORDER = ", ".join(ROLES.sample_order)
SPLITS = 5

INDEXED = f"indexed AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS row_idx FROM wq)"
SIZE = f"size AS (SELECT count(*) AS n, count(*) // {SPLITS + 1} AS t FROM wq)"


@query("row_index", sql("wq", INDEXED, f"SELECT {_keys}, date, station_code, row_idx FROM indexed"))
def row_index(spark, sf_dir):
    return ordering.row_index(wq(spark, sf_dir).select(*KEY, "date", "station_code"),
                              ROLES.sample_order)


@query("time_series_folds", sql("wq", INDEXED, SIZE, f"""
SELECT CAST(f AS BIGINT) AS fold, (n - ({SPLITS} - f + 1) * t) AS n_train, t AS n_test,
 (n - ({SPLITS} - f + 1) * t) AS test_start,
 (SELECT max(date) FROM indexed WHERE row_idx < n - ({SPLITS} - f + 1) * t) AS last_train_date,
 (SELECT min(date) FROM indexed WHERE row_idx >= n - ({SPLITS} - f + 1) * t AND row_idx < n - ({SPLITS} - f) * t) AS first_test_date,
 (SELECT max(date) FROM indexed WHERE row_idx >= n - ({SPLITS} - f + 1) * t AND row_idx < n - ({SPLITS} - f) * t) AS last_test_date
FROM size, range(1, {SPLITS + 1}) folds(f)"""))
def time_series_folds(spark, sf_dir):
    done = ordering.sort_rows(wq(spark, sf_dir).select(*KEY, "date", "station_code"),
                              ROLES.sample_order)
    return rounded(ordering.fold_layout(done, SPLITS, "date"))


@query("cv_layout", sql("wq", SIZE, f"""
SELECT CAST(f AS BIGINT) AS fold, 'train' AS part, CAST(0 AS BIGINT) AS first, n - ({SPLITS} - f + 1) * t - 1 AS last FROM size, range(1, {SPLITS + 1}) folds(f)
UNION ALL SELECT f, 'test', n - ({SPLITS} - f + 1) * t, n - ({SPLITS} - f) * t - 1 FROM size, range(1, {SPLITS + 1}) folds(f)"""))
def cv_layout(spark, sf_dir):
    done = ordering.sort_rows(wq(spark, sf_dir).select(*KEY, "date", "station_code"), ROLES.sample_order)
    return rounded(ordering.layout_ranges(done, SPLITS))


@query("holdout_split", sql("wq", INDEXED, SIZE, """
SELECT CASE WHEN row_idx >= n - CAST(ceil(n * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS part,
 count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, sum(l_orderkey)::BIGINT AS key_sum
FROM indexed, size GROUP BY 1"""))
def holdout_split(spark, sf_dir):
    done = ordering.sort_rows(wq(spark, sf_dir).select(*KEY, "date", "station_code"), ROLES.sample_order)
    part = ordering.holdout_part(F.col("row_idx"), done.n_rows)
    return (done.numbered().groupBy(part.alias("part"))
            .agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"),
                 F.max("date").alias("last_date"), F.sum("l_orderkey").alias("key_sum")))


@query("first_per_key", sql("wq", f"""
SELECT DISTINCT ON (station_code) station_code, date, {_keys}, v1 FROM wq ORDER BY station_code, date, {_keys}"""))
def first_per_key(spark, sf_dir):
    return ordering.first_per_key(wq(spark, sf_dir).select("station_code", "date", *KEY, "v1"),
                                  ["station_code"], ["date", *KEY])


@query("shuffled_folds")
def shuffled_folds(spark, sf_dir):
    rows = wq(spark, sf_dir).withColumn("fold", ordering.shuffled_fold(KEY, 5))
    return rows.groupBy("fold").agg(F.count("*").alias("n_rows"))


@query("metrics_overall", sql("wq pred", f"scored AS (SELECT {scores_sql()}, count(*) AS N FROM pred)", f"""
SELECT {r('R2', 6)} AS R2, {r('RMSE', 6)} AS RMSE, {r('PBIAS', 6)} AS PBIAS, {r('NSE', 6)} AS NSE, N FROM scored"""))
def metrics_overall(spark, sf_dir):
    return rounded(reports.overall_scores(predictions(spark, sf_dir), "y", "p"), 6)


_group = lambda level: (f"SELECT '{level}' AS level, {level} AS grupo, {scores_sql()}, count(*) AS N_Muestras"
                        f" FROM pred GROUP BY {level} HAVING count(*) >= 2")


@query("metrics_by_group", sql("wq pred", f"scored AS ({_group('basin')} UNION ALL {_group('station_code')})", f"""
SELECT level, grupo, {r('R2', 3)} AS R2, {r('NSE', 3)} AS NSE, {r('RMSE', 3)} AS RMSE, {r('PBIAS', 3)} AS PBIAS, N_Muestras
FROM scored WHERE R2 IS NOT NULL AND NSE IS NOT NULL AND PBIAS IS NOT NULL"""))
def metrics_by_group(spark, sf_dir):
    return reports.group_scores(predictions(spark, sf_dir), ["basin", "station_code"], "y", "p")


@query("regression_line", sql("wq pred", f"""
SELECT {r('regr_slope(p, y)', 6)} AS slope, {r('regr_intercept(p, y)', 6)} AS intercept FROM pred"""))
def regression_line(spark, sf_dir):
    return rounded(reports.regression_line(predictions(spark, sf_dir), "y", "p"), 6)


_MEANS = ", ".join(f"{r(f'avg({c})')} AS {c}" for c in SCORE_COLUMNS)
COMPARISON = f"""comparison AS (SELECT base_experiment_id,
 coalesce(CAST(cluster_id AS VARCHAR), 'General') AS cluster_id, {_MEANS} FROM fold_results GROUP BY 1, 2)"""


@query("experiment_comparison", sql("folds", COMPARISON, """
SELECT *, base_experiment_id || ' (' || cluster_id || ')' AS display_id,
 CASE WHEN cluster_id = 'General' THEN 'General' ELSE 'Por Cluster' END AS run_type FROM comparison"""))
def experiment_comparison(spark, sf_dir):
    return reports.with_display_labels(reports.experiment_comparison(fold_results(spark, sf_dir)))


@query("fold_summary", sql("folds", "SELECT model, " + ", ".join(
    f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_samp({c})')} AS {c}_std"
    for c in (*SCORE_COLUMNS, "training_time_secs")) + " FROM fold_results GROUP BY model"))
def fold_summary(spark, sf_dir):
    return reports.fold_summary(fold_results(spark, sf_dir))


@query("kfold_rmse", sql("folds", f"""
SELECT model, {r('avg(RMSE_log)', 6)} AS rmse_mean, {r('stddev_pop(RMSE_log)', 6)} AS rmse_std
FROM fold_results GROUP BY model"""))
def kfold_rmse(spark, sf_dir):
    return rounded(reports.kfold_rmse(fold_results(spark, sf_dir)), 6)


@query("convergence_pivot", sql("folds", "SELECT model, " + ", ".join(
    f"count(CASE WHEN convergence_status = '{s}' THEN 1 END) AS \"{s}\"" for s in reports.STATUSES)
    + " FROM fold_results GROUP BY model"))
def convergence_pivot(spark, sf_dir):
    return reports.convergence_counts(fold_results(spark, sf_dir))


def _text(column, digits):
    return (f"coalesce(printf('%.{digits}f', CAST(round(CAST({column} AS DECIMAL(38,10)), {digits}) AS DOUBLE)), '---')")


@query("comparison_table", sql("folds", COMPARISON, f"""
SELECT replace(base_experiment_id, '_', ' ') AS experiment, cluster_id,
 count(*) OVER (PARTITION BY base_experiment_id) AS group_size,
 row_number() OVER (PARTITION BY base_experiment_id ORDER BY cluster_id) = 1 AS first_of_group,
 {_text('R2_log', 3)} AS r2, {_text('RMSE_log', 3)} AS rmse, {_text('PBIAS_log', 2)} AS pbias FROM comparison"""))
def comparison_table(spark, sf_dir):
    return reports.comparison_table(reports.experiment_comparison(fold_results(spark, sf_dir)))


@query("ranked_summaries", sql("folds", f"""
SELECT base_experiment_id AS experiment_id, model, {r('avg(R2_log)')} AS R2_log_mean,
 {r('avg(RMSE_log)')} AS RMSE_log_mean, {r('avg(training_time_secs)')} AS training_time_secs_mean
FROM fold_results GROUP BY 1, 2"""))
def ranked_summaries(spark, sf_dir):
    results = fold_results(spark, sf_dir)
    each = results.groupBy(F.col("base_experiment_id").alias("experiment_id"), "model").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("R2_log", "RMSE_log", "training_time_secs")])
    return reports.ranked_summaries(each)


@query("union_results", sql("folds", """
SELECT base_experiment_id, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n_rows, count(fold) AS n_folds, count(R2_log) AS n_r2 FROM (
 SELECT base_experiment_id, cluster_id, fold, R2_log FROM fold_results UNION ALL
 SELECT base_experiment_id, NULL, NULL, R2_log FROM fold_results WHERE cluster_id IS NULL) GROUP BY ALL"""))
def union_results(spark, sf_dir):
    results = fold_results(spark, sf_dir)
    searched = results.where(F.col("cluster_id").isNull()).select("base_experiment_id", "R2_log")
    return rounded(reports.union_results([results, searched]).groupBy("base_experiment_id", "cluster_id")
                   .agg(F.count("*").alias("n_rows"), F.count("fold").alias("n_folds"),
                        F.count("R2_log").alias("n_r2")))


@query("cluster_profile", sql("basin_all", f"""
SELECT CAST(substr(station_code, 2) AS BIGINT) % 3 AS cluster_id,
 {', '.join(f"{r(f'avg({c})', 2)} AS {c}" for c in BASIN_PARAMETERS)} FROM basin_wide GROUP BY 1"""))
def cluster_profile(spark, sf_dir):
    basins = basin_table(spark, sf_dir, holes=False)
    clusters = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("station_code"),
        (F.col("s_suppkey") % 3).alias("cluster_id"))
    return reports.cluster_profile(clusters, basins, BASIN_PARAMETERS)


_z = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"


@query("standardize", sql("wq", f"""
SELECT {_keys}, {r(_z('v1'), 6)} AS v1, {r(_z('v4'), 6)} AS v4, CAST(0 AS DOUBLE) AS fixed FROM wq"""))
def standardize(spark, sf_dir):
    rows = wq(spark, sf_dir).select(*KEY, "v1", "v4", F.lit(7.0).alias("fixed"))
    scaled = scaling.standardize(rows, ["v1", "v4", "fixed"])
    return scaled.withColumns({c: round_to(F.col(c), 6) for c in ("v1", "v4")})


_m = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"


@query("minmax", sql("wq", f"""
SELECT {_keys}, {r(_m('v1'), 6)} AS v1, {r(_m('v4'), 6)} AS v4, CAST(0 AS DOUBLE) AS fixed FROM wq"""))
def minmax(spark, sf_dir):
    rows = wq(spark, sf_dir).select(*KEY, "v1", "v4", F.lit(7.0).alias("fixed"))
    scaled = scaling.minmax_scale(rows, ["v1", "v4", "fixed"])
    return scaled.withColumns({c: round_to(F.col(c), 6) for c in ("v1", "v4")})


@query("impute_and_scale", sql("wq", """filled AS (
 SELECT station_code, coalesce(v1, (SELECT median(v1) FROM wq)) AS v1, coalesce(v5, (SELECT median(v5) FROM wq)) AS v5 FROM wq)""",
    f"scaled AS (SELECT station_code, {_z('v1')} AS v1, {_z('v5')} AS v5 FROM filled)", f"""
SELECT station_code, {r('sum(v1)')} AS v1, {r('sum(v5)')} AS v5 FROM scaled GROUP BY station_code"""))
def impute_and_scale(spark, sf_dir):
    rows = wq(spark, sf_dir).select("station_code", "v1", "v5")
    scaled, _ = scaling.impute_and_scale(rows, rows, ["v1", "v5"])
    return rounded(scaled.groupBy("station_code").agg(F.sum("v1").alias("v1"), F.sum("v5").alias("v5")))


@query("export_decimals", sql("wq", f"""
SELECT count(*) AS n_rows, {', '.join(f"count(CASE WHEN abs({c} - round({c}, 4)) > 1e-9 THEN 1 END) AS {c}" for c in VARIABLES)} FROM wq"""))
def export_decimals(spark, sf_dir):
    return sinks.excess_decimals(wq(spark, sf_dir).select(*VARIABLES))
