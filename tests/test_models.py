from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwater.config import Experiment, Roles
from rillwater.models import clusters, moments, prefixes, registry, search, validation
from rillwater.operators import reports, scaling
from rillwater.plans import runs
from rillwater.sources import sinks

START = datetime(2020, 1, 1)
ROLES = Roles(target="t", features=("a", "b"), sample_key=("id",))
FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    n = 400
    a, b = rng.normal(1000, 5, n), rng.normal(size=n)
    y = 0.2 * (a - 1000) - 0.5 * b + rng.normal(scale=0.1, size=n) + 8
    frame = pd.DataFrame({"id": range(n), "date": [START + timedelta(days=i // 3) for i in range(n)],
                          "station_code": [f"s{i % 7}" for i in range(n)],
                          "basin": [f"b{i % 2}" for i in range(n)], "t": np.expm1(y), "a": a, "b": b})
    frame.loc[5, "a"] = np.nan
    schema = ("id int, date timestamp_ntz, station_code string, basin string, t double, a double, b double")
    rows = [(int(r.id), r.date.to_pydatetime(), r.station_code, r.basin, r.t, None if np.isnan(r.a) else r.a, r.b)
            for r in frame.itertuples()]
    return frame, spark.createDataFrame(rows, schema).cache()


def ordered(frame):
    full = frame.dropna(subset=["t", "a", "b"]).sort_values(["date", "station_code", "id"])
    return full[FEATURES].to_numpy(), np.log1p(full["t"].to_numpy())


def ridge(x, y, alpha):
    centre, mean = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - centre).T @ (x - centre) + alpha * np.eye(x.shape[1]), (x - centre).T @ (y - mean))
    return lambda z: mean + (z - centre) @ w


def expected_scores(y, p):
    sse, sst = ((p - y) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    return {"R2_log": 1 - sse / sst, "RMSE_log": np.sqrt(sse / len(y)), "PBIAS_log": 100 * (p - y).sum() / y.sum(),
            "NSE_log": 1 - sse / sst}


@pytest.mark.parametrize("name, params, alpha", [
    (registry.LINEAR, {}, 0.0), (registry.RIDGE, {"alpha": 25.0}, 25.0), (registry.RIDGE, {}, 1.0)])
def test_linear_models_equal_the_closed_form(samples, name, params, alpha):
    frame, df = samples
    x, y = ordered(frame)
    rows, features = validation.model_rows(df, ROLES, ["a", "b", "absent"])
    assert features == FEATURES and rows.count() == len(y)
    model = validation.fit_model(rows, features, name, params)
    got = validation.predict(model, rows).orderBy("date", "station_code", "id").toPandas()["prediction"]
    np.testing.assert_allclose(got, ridge(x, y, alpha)(x), rtol=1e-7)
    assert validation.convergence(model) == "N/A"


@pytest.mark.parametrize("alpha", [0.0, 0.5, 100.0])
def test_fold_scores_from_products_equal_single_fits(samples, alpha):
    frame, df = samples
    x, y = ordered(frame)
    table, features = validation.sorted_model_rows(df, ROLES, FEATURES)
    found = moments.score_penalties(table, features, 4, [alpha])[0]
    size = len(y) // 5
    for i, scores in enumerate(found):
        start = len(y) - (4 - i) * size
        test = slice(start, start + size)
        want = expected_scores(y[test], ridge(x[:start], y[:start], alpha)(x[test]))
        for metric, value in want.items():
            assert scores[metric] == pytest.approx(value, rel=1e-6)


def test_validation_reports_the_last_fold(samples):
    frame, df = samples
    table, features = validation.sorted_model_rows(df, ROLES, FEATURES)
    done = validation.forward_validation(table, features, registry.LINEAR, splits=3, base_id="x", cluster_id=2)
    results = done.results.orderBy("fold").collect()
    assert [r["fold"] for r in results] == [1, 2, 3] and {r["cluster_id"] for r in results} == {2}
    last = reports.overall_scores(done.last_predictions, "y", "prediction").first()
    assert last["N"] == 399 // 4 and last["R2"] == pytest.approx(results[-1]["R2_log"], rel=1e-6)
    assert {"station_code", "basin", "date"} <= set(done.last_predictions.columns)


@pytest.mark.parametrize("name", registry.TREES)
def test_tasks_of_trees_hold_a_bounded_number_of_rows(spark, monkeypatch, name):
    """Rows of one task are dealt out before trees are fitted, and the same rows give the same trees."""
    monkeypatch.setattr(registry, "TASK_BYTES", 100 * (registry.ROW_BYTES + 4 * 3), raising=False)
    rows = spark.range(2000).select((F.col("id") % 40).cast("double").alias("x"), F.sqrt("id").alias("z"),
                                    (F.col("id") % 40 % 7).cast("double").alias(registry.LABEL)).coalesce(1)
    seen, whole = [], validation.Pipeline.fit
    def fit(pipeline, train):
        seen.append([r["n"] for r in train.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return whole(pipeline, train)
    monkeypatch.setattr(validation.Pipeline, "fit", fit)
    params = {"n_estimators": 2, "max_depth": 8, "random_state": 1}
    models = [validation.fit_model(rows, ["x", "z"], name, params) for _ in range(2)]
    assert sum(seen[0]) == 2000 and max(seen[0]) <= 110
    assert models[0].stages[-1].toDebugString.split("\n")[1:] == models[1].stages[-1].toDebugString.split("\n")[1:]


def test_forest_is_repeatable_and_learns(samples):
    _, df = samples
    table, features = validation.sorted_model_rows(df, ROLES, FEATURES)
    params = {"n_estimators": 5, "max_depth": 5, "random_state": 1, "unknown": 3}
    one, two = (validation.forward_validation(table, features, registry.FOREST, params, 2).results
                .drop("training_time_secs").collect() for _ in range(2))
    assert one == two and one[-1]["R2_log"] > 0.3
    assert one[0]["convergence_status"] == "N/A"


def test_factory_maps_parameters():
    forest = registry.make_estimator(registry.FOREST, {"max_depth": None, "min_samples_leaf": 3})
    assert (forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getNumTrees()) == (30, 3, 100)
    assert forest.getFeatureSubsetStrategy() == "all"
    boosting = registry.make_estimator(registry.BOOSTING, {"learning_rate": 0.3})
    assert (boosting.getMaxIter(), boosting.getMaxDepth(), boosting.getStepSize()) == (100, 3, 0.3)
    with pytest.raises(ValueError):
        registry.make_estimator("other")
    with pytest.raises(ValueError, match="activation"):
        registry.make_estimator(registry.NETWORK, {"activation": "step"})


def test_trials(samples):
    grid = search.grid_trials({"b": [1, 2], "a": [3, 4]})
    assert grid == [{"a": 3, "b": 1}, {"a": 3, "b": 2}, {"a": 4, "b": 1}, {"a": 4, "b": 2}]
    space = {"n_estimators": (2, 9), "max_depth": (1, 3)}
    assert search.random_trials(space, 5, 1) == search.random_trials(space, 5, 1)
    assert search.random_trials(space, 5, 1) != search.random_trials(space, 5, 2)
    assert all(2 <= t["n_estimators"] <= 9 for t in search.random_trials(space, 50))


def test_ties_go_to_the_first_trial(samples):
    _, df = samples
    table, features = validation.sorted_model_rows(df, ROLES, FEATURES)
    found = search.grid_search(table, features, registry.FOREST,
                               {"n_estimators": [3], "max_depth": [3], "min_samples_split": [2, 5]}, 2)
    rows = found.trials.orderBy("trial").collect()
    assert rows[0]["mean_r2"] == rows[1]["mean_r2"] and [r["rank"] for r in rows] == [1, 2]
    assert found.best_params["min_samples_split"] == 2
    with pytest.raises(NotImplementedError):
        search.random_search(table, features, registry.RIDGE, {"alpha": (1, 2)})


@pytest.mark.parametrize("name", [registry.FOREST, registry.BOOSTING])
def test_sizes_of_one_fit_equal_the_ensemble_cut_by_hand(samples, name):
    _, df = samples
    train, test = df.where("date < '2020-03-15'"), df.where("date >= '2020-03-15'")
    rows, tested = (validation.model_rows(part, ROLES, ["a", "b"])[0] for part in (train, test))
    params = {"max_depth": 3, "random_state": 5}
    got = prefixes.fit_sizes(rows, tested, ["a", "b"], name, params, [1, 3, 6])
    model = validation.fit_model(rows, ["a", "b"], name, {**params, "n_estimators": 6})
    inputs = model.stages[0].transform(tested)
    weights = model.stages[-1].treeWeights
    for i, tree in enumerate(model.stages[-1].trees):
        inputs = tree.setPredictionCol(f"t{i}").transform(inputs)
    frame = inputs.toPandas()
    for size in (1, 3, 6):
        total = sum(frame[f"t{i}"] * weights[i] for i in range(size))
        guess = total / size if name == registry.FOREST else total
        r2 = 1 - ((guess - frame["y"]) ** 2).sum() / ((frame["y"] - frame["y"].mean()) ** 2).sum()
        assert got[size]["R2_log"] == pytest.approx(r2, abs=1e-9)
        cut = prefixes.first_trees(df.sparkSession, model.stages[-1], size)
        assert cut.getNumTrees == size
    if name == registry.BOOSTING:  # three steps are the first three of six
        short = validation.fit_fold(rows, tested, ["a", "b"], name, {**params, "n_estimators": 3}).scores
        assert got[3]["R2_log"] == pytest.approx(short["R2_log"], abs=1e-9)
    with pytest.raises(ValueError):
        prefixes.first_trees(df.sparkSession, model.stages[-1], 7)


def test_a_line_of_a_grid_is_fitted_once_for_each_fold(samples, monkeypatch):
    fits = []
    fit = prefixes.fit_model
    monkeypatch.setattr(prefixes, "fit_model", lambda *a: fits.append(a[3]) or fit(*a))
    table, features = validation.sorted_model_rows(samples[1], ROLES, ["a", "b"])
    grid = {"n_estimators": [2, 4, 6], "max_depth": [2, 3], "min_samples_split": [2, 5]}
    with pytest.warns(UserWarning, match="min_samples_split"):
        found = search.grid_search(table, features, registry.FOREST, grid, 2)
    assert sorted((p["max_depth"], p["n_estimators"]) for p in fits) == [(2, 6), (2, 6), (3, 6), (3, 6)]
    rows = found.trials.orderBy("trial").collect()
    assert len(rows) == 12 and sorted(r["rank"] for r in rows) == list(range(1, 13))
    by_first = {r["trial"]: r["mean_r2"] for r in rows}
    assert all(r["mean_r2"] == by_first[r["same_as"]] for r in rows)
    assert len({r["same_as"] for r in rows}) == 6


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, None)], "x double, flat double")
    rows = scaling.standardize(df, ["x", "flat"]).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0), (None, None)]
    rows = scaling.minmax_scale(df, ["x", "flat"]).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (1.0, 0.0), (None, None)]
    stage = scaling.standard_stage(scaling.fit_standard(df, ["x", "flat"]))
    assert [r["x_std"] for r in stage.transform(df).collect()] == [-1.0, 1.0, None]
    filled = scaling.fill_median(df, df, ["x"]).collect()
    assert filled[2]["x"] == 2.0
    _, test = scaling.impute_and_scale(df, spark.createDataFrame([(None,), (5.0,)], "x double"), ["x"])
    assert [r["x"] for r in test.collect()] == pytest.approx([0.0, 3 / (2 / 3) ** 0.5])


def test_scores_of_odd_groups(spark):
    rows = [("same", 1.0, 1.0), ("same", 1.0, 1.0), ("off", 1.0, 2.0), ("off", 1.0, 1.0), ("zero", -1.0, 0.0),
            ("zero", 1.0, 1.0), ("one", 1.0, 1.0), ("good", 1.0, 1.5), ("good", 3.0, 2.5), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "basin string, y double, p double").withColumn("station_code", F.col("basin"))
    each = {g: reports.overall_scores(df.where(F.col("basin") == g), "y", "p").first()
            for g in ("same", "off", "zero", "one", "good")}
    assert (each["same"]["R2"], each["same"]["NSE"]) == (1.0, None)
    assert (each["off"]["R2"], each["off"]["NSE"]) == (0.0, None)
    assert each["zero"]["PBIAS"] is None and each["one"]["R2"] is None
    assert each["good"]["R2"] == pytest.approx(0.75) and each["good"]["PBIAS"] == 0.0
    shown = reports.group_scores(df, ["basin", "station_code"], "y", "p").collect()
    assert sorted((r["level"], r["grupo"]) for r in shown) == [("basin", "good"), ("station_code", "good")]


def test_clusters_do_not_depend_on_row_order(spark):
    rows = [(f"s{i}", float(i // 10 * 100 + i % 10), float(i % 10)) for i in range(30)]
    rows += [("s1", 1.0, 1.0), ("gap", None, 1.0)]
    df = spark.createDataFrame(rows, "station_code string, area double, slope double")
    one = {r[0]: r[1] for r in clusters.station_clusters(df, 3, ["area", "slope", "absent"]).collect()}
    two = {r[0]: r[1] for r in clusters.station_clusters(df.repartition(5), 3, ["area", "slope"]).collect()}
    assert one == two and set(one.values()) == {0, 1, 2} and "gap" not in one and len(one) == 30
    with pytest.raises(ValueError):
        clusters.station_clusters(df.where("station_code = 'gap'"), 2, ["area"])


def test_a_run_is_saved_and_found_again(spark, samples, tmp_path):
    _, df = samples
    exp = Experiment("R1", registry.RIDGE, ("a", "b"), search="grid", param_grid={"alpha": [0.1, 1e6]},
                     time_series_splits=3, min_station_samples=20)
    done = runs.run_all(df, None, [exp], ROLES)
    assert [r.experiment.id for r in done] == ["R1", "R1_VALIDATION"]
    assert done[0].in_sample and not done[1].in_sample
    assert done[0].search.best_params == {"alpha": 0.1} and done[1].experiment.hyperparameters == {"alpha": 0.1}
    table = runs.all_results(done)
    assert table.count() == 4
    compared = reports.experiment_comparison(table).collect()
    assert {(r["base_experiment_id"], r["cluster_id"]) for r in compared} == {("R1", "General"), ("R1_VALIDATION", "General")}
    first = done[1].save(str(tmp_path), ROLES, "1")
    model, features = sinks.load_model(spark, f"{first}/models")
    assert features == FEATURES
    again = validation.predict(model, done[1].used_rows).agg(F.sum("prediction")).first()[0]
    assert again == pytest.approx(validation.predict(done[1].model, done[1].used_rows).agg(F.sum("prediction")).first()[0])
    from rillwater.sources import discovery
    assert [r["experiment_id"] for r in discovery.read_run_summaries(spark, str(tmp_path)).collect()] == ["R1_VALIDATION_1"]
    found = discovery.discover_runs(spark, str(tmp_path), [exp]).collect()
    assert [(r["run_id"], r["experiment"], r["strategy"]) for r in found] == [("R1_VALIDATION_1", "R1", "time_series_cv")]
    summary = done[1].summary().first()
    (flat,) = discovery.discover_summaries(spark, f"{tmp_path}/*/{discovery.SUMMARY_FILE}", ["R2_log_mean", "RMSE_log_std"],
                                           "part-*", 2).collect()
    assert (flat["experiment_id"], flat["model"]) == ("R1_VALIDATION_1", registry.RIDGE)
    assert (flat["R2_log_mean"], flat["RMSE_log_std"]) == (summary["R2_log_mean"], summary["RMSE_log_std"])
    assert done[1].save(str(tmp_path), ROLES) != done[1].save(str(tmp_path), ROLES)
    saved = runs.save_reports(done, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{saved}/detailed").count() == 4
    assert spark.read.option("header", True).csv(f"{saved}/comparison").count() == 2


def test_small_tables_are_skipped(samples):
    _, df = samples
    exp = Experiment("R2", registry.LINEAR, ("a",), min_rows=20)
    assert runs.run_experiment(df.limit(19), exp, ROLES) is None


def test_importance_is_sorted(samples, spark):
    _, df = samples
    rows, features = validation.model_rows(df, ROLES, FEATURES)
    model = validation.fit_model(rows, features, registry.FOREST, {"n_estimators": 3, "max_depth": 3})
    table = validation.feature_importance(model, features, spark, n=1).collect()
    assert len(table) == 1 and table[0]["feature"] == "a"


def test_unmapped_parameters_warn_and_too_deep_trees_are_an_error():
    with pytest.warns(UserWarning, match="criterion"):
        registry.make_estimator(registry.FOREST, {"criterion": "mae", "n_estimators": 3})
    with pytest.warns(UserWarning, match="fit_intercept"):
        registry.make_estimator(registry.LINEAR, {"fit_intercept": False})
    with pytest.raises(ValueError, match="levels deep"):
        registry.make_estimator(registry.FOREST, {"max_depth": 31})


def test_sums_of_products_need_no_package_on_the_workers(tmp_path):
    """A session started elsewhere, whose Python workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from rillwater.session import local_session
from rillwater.operators.correlation import correlation_matrix
spark = local_session("elsewhere", 2, 2, "1g")
df = spark.range(50).selectExpr("cast(id as double) a", "cast(id * id as double) b")
print(round(correlation_matrix(df, ["a", "b"]).first()["r"], 3))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("0.967"), done.stderr[-2000:]
