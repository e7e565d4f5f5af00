"""Fitting and judging models on forward-chaining folds."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.models.moments import penalty_of, score_penalties
from rillwater.models.network import NetworkModel
from rillwater.models.registry import (FEATURES, LABEL, PREDICTION, RIDGE, SCALED, TREES,
                                       make_estimator, task_rows)
from rillwater.operators.cleaning import existing
from rillwater.operators.ordering import SortedTable, forward_folds, sort_rows
from rillwater.operators.reports import overall_scores
from rillwater.operators.scaling import fit_standard, standard_stage
from rillwater.plans.keep import store

RESULT_SCHEMA = ("fold int, model string, base_experiment_id string, cluster_id int, "
                 "R2_log double, RMSE_log double, PBIAS_log double, NSE_log double, "
                 "training_time_secs double, convergence_status string")


def model_rows(df: DataFrame, roles: Roles, feature_set: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Complete rows with metadata, numeric features and y = log1p(target)."""
    features = [f for f in existing(df, feature_set) if f != roles.target]
    if not features:
        raise ValueError("none of the features exists")
    keep = existing(df, [*roles.metadata, *roles.sample_key])
    rows = df.select(*dict.fromkeys([*keep, roles.target]),
                     *[F.col(f"`{f}`").cast("double").alias(f) for f in features if f not in keep],
                     F.log1p(F.col(roles.target)).alias(LABEL))
    return rows.dropna(subset=[LABEL, *features]), features


def sorted_model_rows(df: DataFrame, roles: Roles,
                      feature_set: Sequence[str]) -> tuple[SortedTable, list[str]]:
    """The same rows, stored in the order folds are cut from."""
    rows, features = model_rows(df, roles, feature_set)
    return sort_rows(rows, existing(rows, roles.sample_order)), features


def spread_rows(train: DataFrame, features: Sequence[str], name: str, params: Mapping | None = None) -> DataFrame:
    """Training rows of a tree model in tasks of bounded size; what one task can hold is left as it is.

    The learner keeps each task's rows in memory and reads them again for every level. Scans cut tasks by compressed
    bytes, and a fold may lie in few of them. Rows are sorted in each task, so that the same rows give the same trees.
    """
    n_rows, most = train.count(), task_rows(name, params, len(features))
    if n_rows <= most:
        return train
    tasks = max(-(-n_rows // most), train.sparkSession.sparkContext.defaultParallelism)
    columns = list(dict.fromkeys([LABEL, *features]))
    return train.select(*columns).repartition(tasks).sortWithinPartitions(*columns)


def fit_model(train: DataFrame, features: Sequence[str], name: str,
              params: Mapping | None = None) -> PipelineModel:
    """Scale where the model wants it, assemble, fit; returns one pipeline model."""
    stages, inputs, settings = [], list(features), {}
    if name in SCALED:
        # Fitted on the training rows only.
        stages.append(standard_stage(fit_standard(train, features)))
        inputs = [f"{f}_std" for f in features]
    if name == RIDGE:
        n_rows, spread = train.agg(F.count("*"), F.stddev_pop(LABEL)).first()
        settings = {"n_rows": n_rows, "label_std": spread or 0.0}
    if name in TREES:
        train = spread_rows(train, features, name, params)
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error"))
    stages.append(make_estimator(name, params, **settings))
    return Pipeline(stages=stages).fit(train)


def convergence(model: PipelineModel) -> str:
    """``OK`` or ``Not Converged`` for iterative solvers, ``N/A`` for all others."""
    last = model.stages[-1]
    if isinstance(last, NetworkModel):
        return "OK" if last.getOrDefault(last.converged) else "Not Converged"
    if not getattr(last, "hasSummary", False) or last.getSolver() == "normal":
        return "N/A"
    return "OK" if last.summary.totalIterations < last.getMaxIter() else "Not Converged"


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with their prediction; helper columns are dropped, metadata stays."""
    keep = [*rows.columns, PREDICTION]
    return model.transform(rows).select(*[F.col(f"`{c}`") for c in keep])


@dataclass
class FoldFit:
    scores: dict
    model: PipelineModel
    predictions: DataFrame


def fit_fold(train: DataFrame, test: DataFrame, features: Sequence[str], name: str,
             params: Mapping | None = None) -> FoldFit:
    """Train on one part, score on the other."""
    began = time.perf_counter()
    model = fit_model(train, features, name, params)
    seconds = time.perf_counter() - began
    predictions = predict(model, test)
    row = overall_scores(predictions, LABEL, PREDICTION).first()
    scores = {f"{m}_log": row[m] for m in ("R2", "RMSE", "PBIAS", "NSE")}
    scores["training_time_secs"] = seconds
    scores["convergence_status"] = convergence(model)
    return FoldFit(scores, model, predictions)


def result_row(fold: int, name: str, base_id: str, cluster_id: int | None, scores: Mapping) -> tuple:
    return (fold, name, base_id, cluster_id, scores["R2_log"], scores.get("RMSE_log"),
            scores.get("PBIAS_log"), scores.get("NSE_log"), scores.get("training_time_secs"),
            scores.get("convergence_status", "N/A"))


@dataclass
class Validation:
    results: DataFrame
    last_predictions: DataFrame


def forward_validation(table: SortedTable, features: Sequence[str], name: str,
                       params: Mapping | None = None, splits: int = 5, base_id: str = "",
                       cluster_id: int | None = None) -> Validation:
    """Scores of every fold; the predictions of the last fold are kept for reports.

    Linear models are scored on all folds from one scan and fitted once, for the
    last fold; other models are fitted per fold.
    """
    rows, last = [], None
    folds = forward_folds(table.n_rows, splits)
    alpha = penalty_of(name, params)
    if alpha is not None:
        # No fold is fitted on its own, so there is no time to report for one.
        scores = score_penalties(table, features, splits, [alpha])[0]
        rows = [result_row(f.fold, name, base_id, cluster_id, s) for f, s in zip(folds, scores)]
        end = folds[-1]
        model = fit_model(table.slice(0, end.train_end), features, name, params)
        predictions = predict(model, table.slice(end.test_start, end.test_end))
    else:
        for f in folds:
            last = fit_fold(table.slice(0, f.train_end), table.slice(f.test_start, f.test_end),
                            features, name, params)
            rows.append(result_row(f.fold, name, base_id, cluster_id, last.scores))
        predictions = last.predictions
    spark = table.rows.sparkSession
    return Validation(spark.createDataFrame(rows, RESULT_SCHEMA), predictions)


def shuffled_validation(df: DataFrame, features: Sequence[str], name: str, fold: str,
                        folds: int, params: Mapping | None = None, base_id: str = "") -> DataFrame:
    """One fit per value of a fold column, tested on the rows that carry it.

    The rows are stored once, so that no fit repeats the work behind them.
    """
    rows = []
    df = store(df.select(*dict.fromkeys([fold, LABEL, *features])), "folds")
    for i in range(1, folds + 1):
        done = fit_fold(df.where(F.col(fold) != i), df.where(F.col(fold) == i),
                        features, name, params)
        rows.append(result_row(i, name, base_id, None, done.scores))
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def feature_importance(model: PipelineModel, features: Sequence[str], spark,
                       n: int = 15) -> DataFrame:
    """The n most important features of a tree model."""
    weights = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)],
                                  "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def predictions_over_time(predictions: DataFrame, date: str) -> DataFrame:
    return (predictions.select(date, F.col(LABEL).alias("actual"), F.col(PREDICTION).alias("predicted"))
            .orderBy(date))
