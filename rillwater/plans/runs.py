"""Whole modelling runs: filter, search or validate, final fit, reports."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.config import Experiment, Roles
from rillwater.models.clusters import station_clusters
from rillwater.models.registry import LABEL, PREDICTION, TREES
from rillwater.models.search import Search, grid_search, random_search
from rillwater.models.validation import (RESULT_SCHEMA, feature_importance, fit_model,
                                         forward_validation, predict, result_row,
                                         sorted_model_rows)
from rillwater.operators.cleaning import existing
from rillwater.operators.filters import complete_cases, min_station_rows
from rillwater.operators.reports import experiment_comparison, fold_summary, group_scores, regression_line, union_results
from rillwater.plans.keep import settle, store
from rillwater.sources import discovery, sinks

log = logging.getLogger(__name__)


@dataclass
class Run:
    experiment: Experiment
    cluster_id: int | None
    used_rows: DataFrame
    features: list[str]
    results: DataFrame
    model: PipelineModel
    predictions: DataFrame
    in_sample: bool  # predictions of a search are made on the rows it was fitted on
    search: Search | None = None

    def summary(self) -> DataFrame:
        return fold_summary(self.results)

    def spatial(self, roles: Roles) -> DataFrame:
        """Scores by basin and by station."""
        return group_scores(self.predictions, [roles.basin, roles.station], LABEL, PREDICTION)

    def line(self) -> DataFrame:
        return regression_line(self.predictions, LABEL, PREDICTION)

    def importance(self) -> DataFrame | None:
        if self.experiment.model_name not in TREES:
            return None
        return feature_importance(self.model, self.features, self.used_rows.sparkSession)

    def save(self, folder: str, roles: Roles, stamp: str | None = None) -> str:
        """Snapshot, fold results, summaries, spatial report and model below ``folder``.

        The run's folder is the experiment's id and a time stamp, so no run takes the place
        of an earlier one. The two-header summary is what ``discover_summaries`` looks for.
        """
        base = f"{folder.rstrip('/')}/{self.experiment.id}_{stamp or time_stamp()}"
        sinks.write_csv(sinks.snapshot(self.used_rows, roles, self.features),
                        f"{base}/datos_usados_en_modelo")
        sinks.write_csv(self.results, f"{base}/folds")
        sinks.write_csv(self.summary(), f"{base}/summary")
        sinks.write_two_headers(self.summary(), "model", f"{base}/{discovery.SUMMARY_FILE}")
        sinks.write_csv(self.spatial(roles), f"{base}/rendimiento")
        sinks.save_model(self.model, f"{base}/models", self.features)
        return base


def run_experiment(base: DataFrame, exp: Experiment, roles: Roles,
                   cluster_id: int | None = None) -> Run | None:
    """One experiment on the rows it can use; None when there are too few."""
    rows = (base.transform(complete_cases, roles, exp.feature_set)
            .transform(min_station_rows, roles, exp.min_station_samples))
    table, features = sorted_model_rows(rows, roles, exp.feature_set)
    # The count is known from sorting; no job of its own is needed.
    if table.n_rows < exp.min_rows:
        log.warning("%s: fewer than %d rows, skipped", exp.id, exp.min_rows)
        return None
    everything = table.slice(0, table.n_rows)
    spark = base.sparkSession
    if exp.search is None:
        checked = forward_validation(table, features, exp.model_name, exp.hyperparameters,
                                     exp.time_series_splits, exp.base_id, cluster_id)
        model = fit_model(everything, features, exp.model_name, exp.hyperparameters)
        return Run(exp, cluster_id, everything, features, checked.results, model,
                   checked.last_predictions, False)
    if exp.search == "grid":
        found = grid_search(table, features, exp.model_name, exp.param_grid, exp.time_series_splits)
    elif exp.search == "random":
        found = random_search(table, features, exp.model_name, exp.search_space, exp.n_trials,
                              exp.time_series_splits)
    else:
        raise ValueError(f"unknown search {exp.search!r}")
    model = fit_model(everything, features, exp.model_name, found.best_params)
    row = result_row(None, exp.model_name, exp.base_id, cluster_id, {"R2_log": found.best_score})
    return Run(exp, cluster_id, everything, features, spark.createDataFrame([row], RESULT_SCHEMA),
               model, predict(model, everything), True, found)


def run_per_cluster(base: DataFrame, basins: DataFrame, exp: Experiment, roles: Roles) -> list[Run]:
    """The experiment once per station cluster, in ascending cluster number.

    The rows are written once, one folder per cluster; each run then reads only
    its own folder and the columns it needs.
    """
    clusters = settle(station_clusters(basins, exp.n_clusters, exp.cluster_features, roles.station))
    needed = existing(base, dict.fromkeys([*roles.metadata, *roles.sample_key, roles.target,
                                           *exp.feature_set]))
    joined = store(base.select(*[F.col(f"`{c}`") for c in needed]).join(clusters, roles.station),
                   "clusters", by="cluster_id")
    numbers = [r[0] for r in clusters.select("cluster_id").distinct().orderBy("cluster_id").collect()]
    runs = [run_experiment(joined.where(F.col("cluster_id") == n), exp.for_cluster(n), roles, n)
            for n in numbers]
    return [r for r in runs if r is not None]


def run_all(base: DataFrame, basins: DataFrame | None, experiments: Sequence[Experiment],
            roles: Roles) -> list[Run]:
    """All experiments; a search is followed by a validation run with its best parameters."""
    runs: list[Run] = []
    for exp in experiments:
        if exp.n_clusters:
            runs += run_per_cluster(base, basins, exp, roles)
            continue
        run = run_experiment(base, exp, roles)
        if run is None:
            continue
        runs.append(run)
        if run.search is not None:
            checked = run_experiment(base, exp.as_validation(run.search.best_params), roles)
            runs += [checked] if checked else []
    return runs


def all_results(runs: Sequence[Run]) -> DataFrame:
    return union_results([r.results for r in runs])


def save_reports(runs: Sequence[Run], folder: str, stamp: str | None = None) -> str:
    """The two tables of a whole session: every fold of every run, and the comparison of experiments."""
    base = f"{folder.rstrip('/')}/reports_{stamp or time_stamp()}"
    results = store(all_results(runs), "results")
    sinks.write_csv(results, f"{base}/detailed")
    sinks.write_csv(experiment_comparison(results), f"{base}/comparison")
    return base


def time_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
