"""Fits, validation, searches and station clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checkviews.catalog import query, rounded
from checkviews.feature_queries import basin_table
from checkviews.views import BASIN_PARAMETERS, KEY, ROLES, r, scores_sql, sql, table, wq
from rillwater.config import Experiment
from rillwater.models.adaptive import candidate_scores
from rillwater.models.clusters import station_clusters
from rillwater.models.registry import BOOSTING, FOREST, LINEAR, NETWORK, PREDICTION, RIDGE
from rillwater.models.search import grid_search, random_search, random_trials
from rillwater.models.validation import (feature_importance, fit_model, forward_validation,
                                         model_rows, predict, predictions_over_time,
                                         shuffled_validation, sorted_model_rows)
from rillwater.operators.ordering import digest_fold, shuffled_fold
from rillwater.operators.reports import kfold_rmse
from rillwater.plans.keep import scratch
from rillwater.plans.runs import all_results, run_experiment, run_per_cluster
from rillwater.sources import discovery, sinks

SPLITS = 3
_ORDER = ", ".join(ROLES.sample_order)
_SCORES = ("R2_log", "RMSE_log", "PBIAS_log", "NSE_log")
# Few, shallow trees: the checks are about the runs, not about the forest.
SMALL_FOREST = {"n_estimators": 8, "max_depth": 4, "random_state": 42}


def _model_sql(*features):
    """Model rows, their positions, fold ranges, and (fold, part, row) pairs."""
    some = " AND ".join(f"{f} IS NOT NULL" for f in features)
    return (f"""used AS (SELECT *, ln(1 + target) AS y, row_number() OVER (ORDER BY {_ORDER}) - 1 AS row_idx
 FROM wq WHERE target IS NOT NULL AND {some})""", f"""
 ranges AS (SELECT f AS fold, n - ({SPLITS} - f + 1) * t AS start, n - ({SPLITS} - f) * t AS stop
 FROM (SELECT count(*) AS n, count(*) // {SPLITS + 1} AS t FROM used), range(1, {SPLITS + 1}) folds(f))""")


@query("linear_cv", sql("wq", *_model_sql("v1"), """
 fits AS (SELECT fold, regr_slope(y, v1) AS slope, regr_intercept(y, v1) AS intercept
 FROM ranges JOIN used ON row_idx < start GROUP BY fold)""", """
 tested AS (SELECT ranges.fold, y, intercept + slope * v1 AS p FROM ranges JOIN fits USING (fold)
 JOIN used ON row_idx >= start AND row_idx < stop)""", f"""
 scored AS (SELECT fold, {scores_sql()} FROM tested GROUP BY fold)""", f"""
SELECT CAST(fold AS BIGINT) AS fold, 'Linear Regression' AS model, {r('R2', 6)} AS R2_log, {r('RMSE', 6)} AS RMSE_log,
 {r('PBIAS', 6)} AS PBIAS_log, {r('NSE', 6)} AS NSE_log FROM scored"""))
def linear_cv(spark, sf_dir):
    done, features = sorted_model_rows(wq(spark, sf_dir), ROLES, ["v1"])
    results = forward_validation(done, features, LINEAR, splits=SPLITS).results
    return rounded(results.select("fold", "model", *_SCORES), 6)


@query("network_cv_linear", sql("wq", *_model_sql("v1"), """
 fits AS (SELECT fold, regr_slope(y, v1) AS slope, regr_intercept(y, v1) AS intercept
 FROM ranges JOIN used ON row_idx < start GROUP BY fold)""", """
 tested AS (SELECT ranges.fold, y, intercept + slope * v1 AS p FROM ranges JOIN fits USING (fold)
 JOIN used ON row_idx >= start AND row_idx < stop)""", f"""
 scored AS (SELECT fold, {scores_sql()} FROM tested GROUP BY fold)""", f"""
SELECT CAST(fold AS BIGINT) AS fold, 'MLP Neural Network' AS model, {r('R2')} AS R2_log, {r('RMSE')} AS RMSE_log,
 'OK' AS convergence_status FROM scored"""))
def network_cv_linear(spark, sf_dir):
    """A network whose units are linear finds the regression line."""
    done, features = sorted_model_rows(wq(spark, sf_dir), ROLES, ["v1"])
    settings = {"hidden_layer_sizes": (3,), "activation": "identity", "alpha": 0.0, "tol": 1e-7}
    results = forward_validation(done, features, NETWORK, settings, splits=SPLITS).results
    return rounded(results.select("fold", "model", "R2_log", "RMSE_log", "convergence_status"))


_SEARCH_SPACE = {"n_estimators": (50, 500), "max_depth": (5, 40), "min_samples_leaf": (1, 10)}
_trial_values = {"n_estimators": "50 + {k} * 37 % 451", "max_depth": "5 + {k} * 11 % 36", "min_samples_leaf": "1 + {k} * 7 % 10"}


_RATIO = ("sum(ln((g + 1.0::DOUBLE / (high - low + 1)) / (n_good + 1)) "
          "- ln((b + 1.0::DOUBLE / (high - low + 1)) / (n_bad + 1)))")


def _kernel(part: str) -> str:
    test = "good" if part == "good" else "NOT good"
    return f"coalesce(sum(CASE WHEN {test} THEN exp(-0.5 * ((value - center) / h_{part}) ** 2) / (h_{part} * sqrt(2 * pi())) END), 0)"


def _bandwidth(n: str) -> str:
    return f"greatest(1.0::DOUBLE, (high - low) / 5.0::DOUBLE / power(greatest({n}, 1), 0.2::DOUBLE))"


@query("adaptive_search_scores", sql("wq", """
 results AS (SELECT CAST(l_suppkey AS INTEGER) AS trial, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE round(avg(v1), 6) END AS score FROM wq GROUP BY l_suppkey)""", f"""
 history AS ({' UNION ALL '.join(f"SELECT trial, '{p}' AS parameter, {v.format(k='trial')} AS value, score FROM results" for p, v in _trial_values.items())})""", f"""
 candidates AS ({' UNION ALL '.join(f"SELECT p_partkey AS candidate, '{p}' AS parameter, {v.format(k='p_partkey')} AS value FROM part" for p, v in _trial_values.items())})""", f"""
 ranges(parameter, low, high) AS (VALUES {', '.join(f"('{p}', {low}, {high})" for p, (low, high) in _SEARCH_SPACE.items())})""", """
 best AS (SELECT trial FROM results WHERE score IS NOT NULL ORDER BY score DESC, trial
          LIMIT (SELECT CAST(ceil(count(score) * 0.25) AS BIGINT) FROM results))""", """
 marked AS (SELECT parameter, value AS center, trial IN (SELECT trial FROM best) AS good FROM history)""", f"""
 sizes AS (SELECT *, {_bandwidth('n_good')} AS h_good, {_bandwidth('n_bad')} AS h_bad FROM ranges JOIN (
   SELECT parameter, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad FROM marked GROUP BY parameter) USING (parameter))""", f"""
 sums AS (SELECT candidate, parameter, low, high, n_good, n_bad, {_kernel('good')} AS g, {_kernel('bad')} AS b
   FROM candidates JOIN sizes USING (parameter) JOIN marked USING (parameter) GROUP BY ALL)""", f"""
SELECT CAST(candidate AS BIGINT) AS candidate, {r(_RATIO, 6)} AS score FROM sums GROUP BY candidate"""))
def adaptive_search_scores(spark, sf_dir):
    """Stations as trials, parts as candidates: what the sampler makes of a history of any size."""
    results = wq(spark, sf_dir).groupBy(F.col("l_suppkey").cast("int").alias("trial")).agg(F.avg("v1").alias("score"))
    results = results.withColumn("score", F.when(F.col("trial") % 9 != 0, F.round("score", 6)))

    def values(rows, key):
        return rows.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.expr(v.format(k=key)).alias("value"))
                                                    for p, v in _trial_values.items()])).alias("x")).select(*rows.columns, "x.*")

    candidates = values(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate")), "candidate")
    ranges = spark.createDataFrame([(p, *ends) for p, ends in _SEARCH_SPACE.items()], "parameter string, low int, high int")
    return rounded(candidate_scores(values(results, "trial"), candidates, ranges), 6)


@query("ridge_closed_form", sql("wq", *_model_sql("v4"), """
 sums AS (SELECT avg(v4) AS mx, avg(y) AS my, covar_pop(v4, y) * count(*) AS sxy, var_pop(v4) * count(*) AS sxx FROM used)""", """
 line AS (SELECT sxy / (sxx + 100000000) AS slope, my - mx * sxy / (sxx + 100000000) AS intercept FROM sums)""", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('intercept + slope * v4', 6)} AS prediction FROM used, line"""))
def ridge_closed_form(spark, sf_dir):
    rows, features = model_rows(wq(spark, sf_dir), ROLES, ["v4"])
    model = fit_model(rows, features, RIDGE, {"alpha": 1e8})
    return rounded(predict(model, rows).select("l_orderkey", "l_partkey", "l_suppkey", PREDICTION,
                                               F.col("l_linenumber").alias("line")), 6) \
        .withColumn("l_linenumber", F.col("line").cast("int")).drop("line")


_alphas = (0.01, 0.1, 1.0, 10.0, 100.0)


@query("grid_search_ridge", sql("wq", *_model_sql("v1", "v3"), """
 sums AS (SELECT fold, avg(v1) AS m1, avg(v3) AS m2, avg(y) AS my, var_pop(v1) * count(*) AS s11, var_pop(v3) * count(*) AS s22,
  covar_pop(v1, v3) * count(*) AS s12, covar_pop(v1, y) * count(*) AS s1y, covar_pop(v3, y) * count(*) AS s2y
 FROM ranges JOIN used ON row_idx < start GROUP BY fold)""", f"""
 trials AS (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in _alphas)}]) AS alpha, unnest(range({len(_alphas)})) AS trial)""", """
 fits AS (SELECT fold, trial, alpha, m1, m2, my,
  (s1y * (s22 + alpha) - s2y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1,
  (s2y * (s11 + alpha) - s1y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2 FROM sums, trials)""", """
 tested AS (SELECT trial, alpha, ranges.fold, y, my + w1 * (v1 - m1) + w2 * (v3 - m2) AS p FROM ranges JOIN fits USING (fold)
 JOIN used ON row_idx >= start AND row_idx < stop)""", """
 scored AS (SELECT trial, alpha, fold, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2 FROM tested GROUP BY ALL)""", f"""
SELECT trial, 'alpha=' || alpha AS params, {r('avg(r2)', 6)} AS mean_r2,
 CAST(row_number() OVER (ORDER BY avg(r2) DESC, trial) AS BIGINT) AS rank FROM scored GROUP BY trial, alpha"""))
def grid_search_ridge(spark, sf_dir):
    done, features = sorted_model_rows(wq(spark, sf_dir), ROLES, ["v1", "v3"])
    found = grid_search(done, features, RIDGE, {"alpha": list(_alphas)}, SPLITS)
    return rounded(found.trials.drop("same_as"), 6)


@query("predictions_table", sql("wq", *_model_sql("v1"), f"""
 line AS (SELECT regr_slope(y, v1) AS slope, regr_intercept(y, v1) AS intercept FROM used)""", f"""
SELECT date, {r('y', 6)} AS actual, {r('intercept + slope * v1', 6)} AS predicted FROM used, line"""))
def predictions_table(spark, sf_dir):
    rows, features = model_rows(wq(spark, sf_dir), ROLES, ["v1"])
    model = fit_model(rows, features, LINEAR)
    return rounded(predictions_over_time(predict(model, rows), "date"), 6)


@query("forest_cv")
def forest_cv(spark, sf_dir):
    done, features = sorted_model_rows(wq(spark, sf_dir), ROLES, ["v1", "v3", "v4"])
    results = forward_validation(done, features, FOREST, SMALL_FOREST, SPLITS, "forest").results
    return rounded(results.drop("training_time_secs"))


@query("boosting_cv")
def boosting_cv(spark, sf_dir):
    done, features = sorted_model_rows(wq(spark, sf_dir), ROLES, ["v1", "v4"])
    results = forward_validation(done, features, BOOSTING,
                                 {"n_estimators": 5, "max_depth": 3, "random_state": 42}, 2, "boosting").results
    return rounded(results.drop("training_time_secs"))


@query("random_search_forest")
def random_search_forest(spark, sf_dir):
    done, features = sorted_model_rows(wq(spark, sf_dir), ROLES, ["v1", "v4"])
    found = random_search(done, features, FOREST,
                          {"n_estimators": (3, 6), "max_depth": (2, 4), "min_samples_leaf": (1, 5)},
                          n_trials=3, splits=2)
    return rounded(found.trials)


@query("grid_search_forest")
def grid_search_forest(spark, sf_dir):
    done, features = sorted_model_rows(wq(spark, sf_dir), ROLES, ["v1", "v4"])
    found = grid_search(done, features, FOREST,
                        {"n_estimators": [4], "max_depth": [2, 4], "min_samples_split": [2, 5]}, splits=2)
    return rounded(found.trials)


@query("feature_importance")
def importance(spark, sf_dir):
    rows, features = model_rows(wq(spark, sf_dir), ROLES, ["v1", "v3", "v4"])
    model = fit_model(rows, features, FOREST, SMALL_FOREST)
    return rounded(feature_importance(model, features, spark))


@query("shuffled_cv")
def shuffled_cv(spark, sf_dir):
    rows, features = model_rows(wq(spark, sf_dir), ROLES, ["v1", "v3"])
    folded = rows.withColumn("fold", shuffled_fold(KEY, 5))
    results = shuffled_validation(folded, features, LINEAR, "fold", 5)
    return rounded(kfold_rmse(results))


@query("station_clusters")
def clusters(spark, sf_dir):
    return rounded(station_clusters(basin_table(spark, sf_dir, holes=False), 3, BASIN_PARAMETERS))


_RIDGE_RUN = Experiment("RIDGE_v4", RIDGE, ("v1", "v4"), search="grid",
                        param_grid={"alpha": [0.1, 1e6]}, time_series_splits=SPLITS,
                        min_station_samples=20)


_LAST = SPLITS
_PREDICTED = ("""
 sums AS (SELECT fold, avg(v1) AS m1, avg(v4) AS m2, avg(y) AS my, var_pop(v1) * count(*) AS s11, var_pop(v4) * count(*) AS s22,
  covar_pop(v1, v4) * count(*) AS s12, covar_pop(v1, y) * count(*) AS s1y, covar_pop(v4, y) * count(*) AS s2y
 FROM ranges JOIN used ON row_idx < start GROUP BY fold)""", """
 fits AS (SELECT fold, alpha, m1, m2, my,
  (s1y * (s22 + alpha) - s2y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1,
  (s2y * (s11 + alpha) - s1y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2
 FROM sums, (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(1000000 AS DOUBLE)]) AS alpha))""", """
 tested AS (SELECT station_code, basin, alpha, ranges.fold, y, my + w1 * (v1 - m1) + w2 * (v4 - m2) AS p
 FROM ranges JOIN fits USING (fold) JOIN used ON row_idx >= start AND row_idx < stop)""", """
 rated AS (SELECT alpha, avg(r2) AS r2 FROM (SELECT alpha, fold, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2
 FROM tested GROUP BY alpha, fold) GROUP BY alpha)""", f"""
 last AS (SELECT * FROM tested WHERE fold = {_LAST} AND alpha = (SELECT alpha FROM rated ORDER BY r2 DESC, alpha LIMIT 1))""")
_by = lambda level: (f"SELECT '{level}' AS level, {level} AS grupo, {scores_sql()}, count(*) AS N_Muestras"
                     f" FROM last GROUP BY {level} HAVING count(*) >= 2")


@query("experiment_run", sql("wq", """
 eligible AS (SELECT * FROM wq WHERE target IS NOT NULL AND v1 IS NOT NULL AND v4 IS NOT NULL)""", """
 used AS (SELECT *, ln(1 + target) AS y, row_number() OVER (ORDER BY """ + _ORDER + """) - 1 AS row_idx FROM eligible
 WHERE station_code IN (SELECT station_code FROM eligible GROUP BY 1 HAVING count(*) >= 20))""",
    _model_sql("v1")[1], *_PREDICTED, f" scored AS ({_by('basin')} UNION ALL {_by('station_code')})", f"""
SELECT level, grupo, {r('R2', 3)} AS R2, {r('NSE', 3)} AS NSE, {r('RMSE', 3)} AS RMSE, {r('PBIAS', 3)} AS PBIAS, N_Muestras
FROM scored WHERE R2 IS NOT NULL AND NSE IS NOT NULL AND PBIAS IS NOT NULL"""))
def experiment_run(spark, sf_dir):
    """Search, then the validation run with the best parameters; scores by place."""
    rows = wq(spark, sf_dir)
    found = run_experiment(rows, _RIDGE_RUN, ROLES)
    checked = run_experiment(rows, _RIDGE_RUN.as_validation(found.search.best_params), ROLES)
    return checked.spatial(ROLES)


@query("cluster_runs")
def cluster_runs(spark, sf_dir):
    exp = Experiment("LINEAR_BY_CLUSTER", LINEAR, ("v1",), time_series_splits=2, n_clusters=2,
                     cluster_features=BASIN_PARAMETERS)
    runs = run_per_cluster(wq(spark, sf_dir), basin_table(spark, sf_dir, holes=False), exp, ROLES)
    return rounded(all_results(runs).drop("training_time_secs"))


# Trees can learn a function of one column with seven values without error, whatever else they
# are given. So their scores and importances follow from the data and can be stated in SQL.
def _by_line(spark, sf_dir):
    rows = wq(spark, sf_dir).withColumn("line", F.col("l_linenumber").cast("double"))
    return rows.withColumn("target", F.col("line") * F.lit(100.0) + (F.col("line") % 3) * F.lit(7.0))


def _by_line_sql(splits):
    used, _ = _model_sql("v1")
    return (used.replace("FROM wq WHERE target IS NOT NULL AND v1", "FROM lined WHERE target IS NOT NULL AND v1"), f"""
 ranges AS (SELECT f AS fold, n - ({splits} - f + 1) * t AS start, n - ({splits} - f) * t AS stop
 FROM (SELECT count(*) AS n, count(*) // {splits + 1} AS t FROM used), range(1, {splits + 1}) folds(f))""")


_LINED = """lined AS (SELECT * EXCLUDE (target), CAST(l_linenumber AS DOUBLE) AS line,
 l_linenumber * CAST(100 AS DOUBLE) + (l_linenumber % 3) * CAST(7 AS DOUBLE) AS target FROM wq)"""
# A value of the column is predicted by its own mean in the rows before, which is exact.
_EXACT = lambda splits: (*_by_line_sql(splits), """
 means AS (SELECT fold, line, avg(y) AS p FROM ranges JOIN used ON row_idx < start GROUP BY fold, line)""", """
 tested AS (SELECT ranges.fold, y, p FROM ranges JOIN used ON row_idx >= start AND row_idx < stop
 JOIN means ON means.fold = ranges.fold AND means.line = used.line)""", f"""
 scored AS (SELECT fold, {scores_sql()} FROM tested GROUP BY fold)""")


def _fold_sql(splits, model):
    return sql("wq", _LINED, *_EXACT(splits), f"""
SELECT CAST(fold AS BIGINT) AS fold, '{model}' AS model, {r('R2', 6)} AS R2_log, {r('NSE', 6)} AS NSE_log,
 {r('abs(RMSE)', 6)} AS RMSE_log, {r('abs(PBIAS)', 6)} AS PBIAS_log FROM scored""")


def _fold_scores(results):
    return rounded(results.select("fold", "model", "R2_log", "NSE_log", F.abs("RMSE_log").alias("RMSE_log"),
                                  F.abs("PBIAS_log").alias("PBIAS_log")), 6)


@query("forest_cv_exact", _fold_sql(SPLITS, FOREST))
def forest_cv_exact(spark, sf_dir):
    done, features = sorted_model_rows(_by_line(spark, sf_dir), ROLES, ["line", "v1"])
    return _fold_scores(forward_validation(done, features, FOREST, SMALL_FOREST, SPLITS).results)


@query("boosting_cv_exact", _fold_sql(2, BOOSTING))
def boosting_cv_exact(spark, sf_dir):
    done, features = sorted_model_rows(_by_line(spark, sf_dir), ROLES, ["line", "v1"])
    return _fold_scores(forward_validation(done, features, BOOSTING, {"n_estimators": 5, "max_depth": 4, "random_state": 42}, 2).results)


@query("feature_importance_exact", sql("wq", _LINED, *_by_line_sql(SPLITS), f"""
 shares AS (SELECT 'line' AS feature, var_pop(y) - (SELECT sum(n * v) / sum(n) FROM (SELECT count(*) AS n, var_pop(y) AS v FROM used GROUP BY line)) AS part,
  var_pop(y) AS whole FROM used)""", f"""
SELECT feature, {r('part / whole', 6)} AS importance FROM shares UNION ALL
SELECT 'v1', {r('1 - part / whole', 6)} FROM shares"""))
def feature_importance_exact(spark, sf_dir):
    rows, features = model_rows(_by_line(spark, sf_dir), ROLES, ["line", "v1"])
    return rounded(feature_importance(fit_model(rows, features, FOREST, SMALL_FOREST), features, spark), 6)


_FOREST_GRID = {"n_estimators": [4], "max_depth": [4, 5], "min_samples_leaf": [1, 2]}
_FOREST_SPACE = {"n_estimators": (3, 6), "max_depth": (4, 6)}
_RANDOM_TRIALS = [", ".join(f"{k}={v}" for k, v in t.items()) for t in random_trials(_FOREST_SPACE, 3)]


def _trial_sql(params):
    listed = ", ".join(f"'{p}'" for p in params)
    return sql("wq", _LINED, *_EXACT(2), f" trials AS (SELECT unnest([{listed}]) AS params, unnest(range({len(params)})) AS trial)", f"""
SELECT trial, params, {r('mean_r2', 6)} AS mean_r2, row_number() OVER (ORDER BY round(mean_r2, 9) DESC, trial) AS rank
FROM trials, (SELECT avg(R2) AS mean_r2 FROM scored)""")


@query("grid_search_forest_exact", _trial_sql([f"max_depth={d}, min_samples_leaf={m}, n_estimators=4" for d in (4, 5) for m in (1, 2)]))
def grid_search_forest_exact(spark, sf_dir):
    done, features = sorted_model_rows(_by_line(spark, sf_dir), ROLES, ["line", "v1"])
    return rounded(grid_search(done, features, FOREST, _FOREST_GRID, 2).trials.drop("same_as"), 6)


@query("random_search_forest_exact", _trial_sql(_RANDOM_TRIALS))
def random_search_forest_exact(spark, sf_dir):
    done, features = sorted_model_rows(_by_line(spark, sf_dir), ROLES, ["line", "v1"])
    return rounded(random_search(done, features, FOREST, _FOREST_SPACE, 3, 2).trials.drop("same_as"), 6)


_FOLD_KEY = KEY[:4]  # whole numbers, which all engines write alike
_KEY_TEXT = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in _FOLD_KEY)
_DIGEST_FOLD = f"CAST('0x' || substr(md5({_KEY_TEXT}), 1, 8) AS BIGINT) % 5 + 1"


@query("digest_folds", sql("wq", f"SELECT {_DIGEST_FOLD} AS fold, count(*) AS n_rows, sum(l_orderkey) AS keys FROM wq GROUP BY 1"))
def digest_folds(spark, sf_dir):
    rows = wq(spark, sf_dir).withColumn("fold", digest_fold(_FOLD_KEY, 5))
    return rounded(rows.groupBy("fold").agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("keys")))


@query("shuffled_cv_digest", sql("wq", f"""
 used AS (SELECT *, ln(1 + target) AS y, {_DIGEST_FOLD} AS part FROM wq WHERE target IS NOT NULL AND v1 IS NOT NULL)""", """
 folds AS (SELECT unnest(range(1, 6)) AS fold)""", """
 fits AS (SELECT fold, regr_slope(y, v1) AS slope, regr_intercept(y, v1) AS intercept FROM folds JOIN used ON part <> fold GROUP BY fold)""", """
 tested AS (SELECT fold, y, intercept + slope * v1 AS p FROM used JOIN fits ON part = fold)""", f"""
 scored AS (SELECT fold, {scores_sql()} FROM tested GROUP BY fold)""", f"""
SELECT CAST(fold AS BIGINT) AS fold, {r('R2', 6)} AS R2_log, {r('RMSE', 6)} AS RMSE_log FROM scored"""))
def shuffled_cv_digest(spark, sf_dir):
    rows, features = model_rows(wq(spark, sf_dir), ROLES, ["v1"])
    folded = rows.withColumn("fold", digest_fold(_FOLD_KEY, 5))
    return rounded(shuffled_validation(folded, features, LINEAR, "fold", 5).select("fold", "R2_log", "RMSE_log"), 6)


def _planted_basins(spark, sf_dir, groups):
    """Basin features of suppliers in groups that lie far apart."""
    group = F.col("s_suppkey") % groups
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("station_code"),
                                                  (group * 100.0).alias("basin_area_a"), (group * 3.0 + 1).alias("mean_slope"))


@query("station_clusters_planted", "SELECT 'S' || s_suppkey AS station_code, CAST(s_suppkey % 3 AS BIGINT) AS cluster_id FROM supplier")
def station_clusters_planted(spark, sf_dir):
    return rounded(station_clusters(_planted_basins(spark, sf_dir, 3), 3, ("basin_area_a", "mean_slope")))


@query("cluster_runs_planted", sql("wq", f"""
 used AS (SELECT *, ln(1 + target) AS y, l_suppkey % 2 AS cluster_id,
  row_number() OVER (PARTITION BY l_suppkey % 2 ORDER BY {_ORDER}) - 1 AS row_idx FROM wq WHERE target IS NOT NULL AND v1 IS NOT NULL)""", """
 ranges AS (SELECT cluster_id, f AS fold, n - (2 - f + 1) * t AS start, n - (2 - f) * t AS stop
 FROM (SELECT cluster_id, count(*) AS n, count(*) // 3 AS t FROM used GROUP BY 1), range(1, 3) folds(f))""", """
 fits AS (SELECT ranges.cluster_id, fold, regr_slope(y, v1) AS slope, regr_intercept(y, v1) AS intercept
 FROM ranges JOIN used ON ranges.cluster_id = used.cluster_id AND row_idx < start GROUP BY ALL)""", """
 tested AS (SELECT ranges.cluster_id, ranges.fold, y, intercept + slope * v1 AS p FROM ranges JOIN fits USING (cluster_id, fold)
 JOIN used ON ranges.cluster_id = used.cluster_id AND row_idx >= start AND row_idx < stop)""", f"""
 scored AS (SELECT cluster_id, fold, {scores_sql()} FROM tested GROUP BY ALL)""", f"""
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(fold AS BIGINT) AS fold, {r('R2', 6)} AS R2_log, {r('RMSE', 6)} AS RMSE_log FROM scored"""))
def cluster_runs_planted(spark, sf_dir):
    exp = Experiment("LINEAR_PLANTED", LINEAR, ("v1",), time_series_splits=2, n_clusters=2, cluster_features=("basin_area_a", "mean_slope"))
    runs = run_per_cluster(wq(spark, sf_dir), _planted_basins(spark, sf_dir, 2), exp, ROLES)
    return rounded(all_results(runs).select("cluster_id", "fold", "R2_log", "RMSE_log"), 6)


@query("run_report_roundtrip", sql("wq", *_model_sql("v1"), """
 fits AS (SELECT fold, regr_slope(y, v1) AS slope, regr_intercept(y, v1) AS intercept
 FROM ranges JOIN used ON row_idx < start GROUP BY fold)""", """
 tested AS (SELECT ranges.fold, y, intercept + slope * v1 AS p FROM ranges JOIN fits USING (fold)
 JOIN used ON row_idx >= start AND row_idx < stop)""", f"""
 scored AS (SELECT fold, {scores_sql()} FROM tested GROUP BY fold)""", f"""
SELECT 'LINEAR_REPORT_1' AS experiment_id, 'Linear Regression' AS model, {r('avg(R2)')} AS R2_log_mean, {r('avg(RMSE)')} AS RMSE_log_mean,
 {r('stddev_samp(RMSE)')} AS RMSE_log_std FROM scored"""))
def run_report_roundtrip(spark, sf_dir):
    """A run saved with a stamp, its two-header summary found again below the folder of all runs."""
    path = scratch(spark, "saved-runs")
    exp = Experiment("LINEAR_REPORT", LINEAR, ("v1",), time_series_splits=SPLITS)
    run_experiment(wq(spark, sf_dir), exp, ROLES).save(path, ROLES, "1")
    return discovery.discover_summaries(spark, f"{path}/*/{discovery.SUMMARY_FILE}", ["R2_log_mean", "RMSE_log_mean", "RMSE_log_std"], "part-*", 2) \
        .select("experiment_id", "model", "R2_log_mean", "RMSE_log_mean", "RMSE_log_std")


@query("saved_model", sql("wq", *_model_sql("v1"), f"""
 line AS (SELECT regr_slope(y, v1) AS slope, regr_intercept(y, v1) AS intercept FROM used)""", f"""
SELECT date, {r('y', 6)} AS actual, {r('intercept + slope * v1', 6)} AS predicted FROM used, line"""))
def saved_model(spark, sf_dir):
    """A fitted pipeline and its features, saved, loaded and used."""
    path = scratch(spark, "model")
    rows, features = model_rows(wq(spark, sf_dir), ROLES, ["v1"])
    sinks.save_model(fit_model(rows, features, LINEAR), path, features)
    model, names = sinks.load_model(spark, path)
    assert names == features
    return rounded(predictions_over_time(predict(model, rows), "date"), 6)
