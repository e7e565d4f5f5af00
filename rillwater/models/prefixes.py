"""Tree ensembles cut to their first trees, so that one fit serves every number of trees.

The first trees of a forest are a forest of that size, drawn as any other, and the first trees of
a boosted model are the model after that many steps. A search over numbers of trees therefore
fits the largest number only and scores all sizes in one scan of the test rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwater.functions.scores import fit_sums, score_columns
from rillwater.models.registry import FEATURES, LABEL, PREDICTION, SIZE
from rillwater.models.validation import fit_model


def first_trees(spark: SparkSession, model: Model, size: int) -> Model:
    """The ensemble of the first ``size`` trees of a fitted forest or boosted model."""
    whole = model._java_obj
    trees = whole.trees()
    if not 0 < size <= len(trees):
        raise ValueError(f"{size} of {len(trees)} trees")
    context = spark.sparkContext
    kinds = context._jvm.org.apache.spark.ml.regression
    some = context._gateway.new_array(kinds.DecisionTreeRegressionModel, size)
    for i in range(size):
        some[i] = trees[i]
    if isinstance(model, RandomForestRegressionModel):
        cut = RandomForestRegressionModel(kinds.RandomForestRegressionModel(whole.uid(), some, whole.numFeatures()))
        cut._set(numTrees=size)  # the sum over trees is divided by this
        cut._transfer_params_to_java()
    elif isinstance(model, GBTRegressionModel):
        weights = context._gateway.new_array(context._jvm.double, size)
        for i in range(size):
            weights[i] = whole.treeWeights()[i]
        cut = GBTRegressionModel(kinds.GBTRegressionModel(whole.uid(), some, weights, whole.numFeatures()))
    else:
        raise TypeError(f"{type(model).__name__} has no trees to cut")
    return cut.setFeaturesCol(FEATURES).setPredictionCol(PREDICTION)


def fit_sizes(train: DataFrame, test: DataFrame, features: Sequence[str], name: str, params: Mapping,
              sizes: Sequence[int]) -> dict[int, dict]:
    """Scores on ``test`` of every number of trees, from one fit of the largest and one scan."""
    model = fit_model(train, features, name, {**params, SIZE: max(sizes)})
    rows = PipelineModel(model.stages[:-1]).transform(test)
    for size in sizes:
        rows = first_trees(train.sparkSession, model.stages[-1], size).setPredictionCol(f"_by_{size}").transform(rows)
    each = rows.select(LABEL, F.explode(F.array(*[
        F.struct(F.lit(size).alias("size"), F.col(f"_by_{size}").alias(PREDICTION)) for size in sizes])).alias("_of"))
    scored = (each.select(LABEL, "_of.*").groupBy("size").agg(*fit_sums(LABEL, PREDICTION))
              .select("size", *[c.alias(f"{n}_log") for n, c in score_columns().items()]).collect())
    found = {r["size"]: {k: v for k, v in r.asDict().items() if k != "size"} for r in scored}
    nothing = dict.fromkeys(f"{n}_log" for n in score_columns())  # no test rows
    return {size: found.get(size, nothing) for size in sizes}
