"""Result tables: scores, comparisons, summaries, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwater.config import CLUSTER_LABEL, GENERAL_LABEL, SCORE_COLUMNS, TIME_COLUMN
from rillwater.functions.numbers import round_to
from rillwater.functions.scores import fit_sums, score_columns


def overall_scores(predictions: DataFrame, observed: str, predicted: str) -> DataFrame:
    """R2, RMSE, PBIAS, NSE and N over all rows, from one aggregate."""
    return predictions.agg(*fit_sums(observed, predicted)).select(
        *[c.alias(n) for n, c in score_columns().items()], F.col("n").alias("N"))


def group_scores(predictions: DataFrame, groups: Sequence[str], observed: str, predicted: str,
                 digits: int = 3) -> DataFrame:
    """Scores by each grouping column, all groupings from one scan.

    Groups with fewer than two rows or with an undefined score are left out.
    """
    sets = predictions.groupingSets([[g] for g in groups], *groups)
    level, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, g in enumerate(groups):
        # grouping_id has a zero bit for the column that is grouped by.
        own = ((1 << len(groups)) - 1) ^ (1 << (len(groups) - 1 - i))
        level = F.when(F.col("_set") == own, F.lit(g)).otherwise(level)
        label = F.when(F.col("_set") == own, F.col(g).cast("string")).otherwise(label)
    sums = sets.agg(*fit_sums(observed, predicted), F.grouping_id().alias("_set"))
    scored = (sums.select(level.alias("level"), label.alias("grupo"), F.col("n"),
                          *[c.alias(n) for n, c in score_columns().items()])
              .where(F.col("grupo").isNotNull() & (F.col("n") >= 2))
              .dropna(subset=["R2", "RMSE", "PBIAS", "NSE"]))
    return scored.select("level", "grupo", *[round_to(F.col(n), digits).alias(n)
                                             for n in ("R2", "NSE", "RMSE", "PBIAS")],
                         F.col("n").alias("N_Muestras"))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def union_results(tables: Sequence[DataFrame]) -> DataFrame:
    """Result tables below each other; missing columns become null."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def _cluster_text() -> Column:
    return F.coalesce(F.col("cluster_id").cast("string"), F.lit(GENERAL_LABEL))


def experiment_comparison(results: DataFrame, digits: int = 4) -> DataFrame:
    """Mean scores per experiment and cluster, best R2 first."""
    scores = [c for c in SCORE_COLUMNS if c in results.columns]
    means = (results.groupBy("base_experiment_id", _cluster_text().alias("cluster_id"))
             .agg(*[round_to(F.avg(c), digits).alias(c) for c in scores]))
    return means.orderBy(F.col("R2_log").desc_nulls_last(), "base_experiment_id", "cluster_id")


def with_display_labels(comparison: DataFrame) -> DataFrame:
    """Adds the chart label and whether a run belongs to a cluster."""
    return comparison.withColumns({
        "display_id": F.concat("base_experiment_id", F.lit(" ("), "cluster_id", F.lit(")")),
        "run_type": F.when(F.col("cluster_id") != GENERAL_LABEL, CLUSTER_LABEL)
        .otherwise(GENERAL_LABEL)})


def fold_summary(results: DataFrame, digits: int = 4) -> DataFrame:
    """Mean and sample deviation of every score per model."""
    scores = [c for c in (*SCORE_COLUMNS, TIME_COLUMN) if c in results.columns]
    return results.groupBy("model").agg(*[
        e for c in scores for e in (round_to(F.avg(c), digits).alias(f"{c}_mean"),
                                    round_to(F.stddev_samp(c), digits).alias(f"{c}_std"))])


def kfold_rmse(results: DataFrame) -> DataFrame:
    """RMSE over folds per model: mean and population deviation."""
    return results.groupBy("model").agg(F.avg("RMSE_log").alias("rmse_mean"),
                                        F.stddev_pop("RMSE_log").alias("rmse_std"))


# What a fit can report about its convergence.
STATUSES = ("OK", "Not Converged", "N/A")


def convergence_counts(results: DataFrame) -> DataFrame:
    """Number of folds per model and status, zero where none."""
    return (results.groupBy("model").pivot("convergence_status", list(STATUSES))
            .agg(F.count(F.lit(1))).fillna(0))


def _fixed_text(name: str, digits: int) -> Column:
    text = F.format_string(f"%.{digits}f", round_to(F.col(name), digits))
    return F.coalesce(F.when(F.col(name).isNotNull(), text), F.lit("---"))


def comparison_table(comparison: DataFrame) -> DataFrame:
    """The printed table: sorted, group size and first row of a group marked."""
    group = Window.partitionBy("base_experiment_id")
    return (comparison
            .withColumns({"group_size": F.count("*").over(group),
                          "first_of_group": F.row_number().over(group.orderBy("cluster_id")) == 1})
            .select(F.replace(F.col("base_experiment_id"), F.lit("_"), F.lit(" ")).alias("experiment"),
                    "cluster_id", "group_size", "first_of_group",
                    _fixed_text("R2_log", 3).alias("r2"), _fixed_text("RMSE_log", 3).alias("rmse"),
                    _fixed_text("PBIAS_log", 2).alias("pbias"))
            .orderBy("experiment", "cluster_id"))


def ranked_summaries(summaries: DataFrame, digits: int = 4) -> DataFrame:
    """Run summaries by mean R2, best first."""
    shown = ["R2_log_mean", "RMSE_log_mean", f"{TIME_COLUMN}_mean"]
    return (summaries.select("experiment_id", "model",
                             *[round_to(F.col(c), digits).alias(c) for c in shown])
            .orderBy(F.col("R2_log_mean").desc_nulls_last(), "experiment_id", "model"))


def cluster_profile(clusters: DataFrame, basins: DataFrame, features: Sequence[str],
                    station: str = "station_code", digits: int = 2) -> DataFrame:
    """Mean basin attributes per cluster."""
    return (clusters.join(basins, station).groupBy("cluster_id")
            .agg(*[round_to(F.avg(c), digits).alias(c) for c in features]))
