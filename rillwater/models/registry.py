"""Model names and parameters to Spark ML estimators."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.ml.base import Estimator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

from rillwater.models.network import NetworkRegressor

# Model names used in experiment definitions.
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
LINEAR = "Linear Regression"
RIDGE = "Ridge"
NETWORK = "MLP Neural Network"

# Models whose features are standardised before fitting.
SCALED = (LINEAR, NETWORK)
TREES = (FOREST, BOOSTING)

FEATURES, LABEL, PREDICTION = "features", "y", "prediction"
# Number of trees, and how many there are where none is given.
SIZE, USUAL_SIZE = "n_estimators", 100
# Memory that the rows of one task may take while trees are fitted, and what a row takes besides its counts and bins.
TASK_BYTES, ROW_BYTES = 128 * 1024 * 1024, 200
# Hard limit of the tree learner; "no limit" is mapped to it.
DEEPEST = 30


def _feature_share(value) -> str:
    if value in (None, 1.0, "all"):
        return "all"
    return {"sqrt": "sqrt", "log2": "log2"}.get(value, str(value))


def _common(params: Mapping, known: Mapping[str, tuple[str, Callable]]) -> dict:
    """Translate known parameters; every other name is ignored with a warning."""
    found = {spark: turn(params[name]) for name, (spark, turn) in known.items() if name in params}
    _warn_of(set(params) - set(known))
    return found


def _warn_of(names: set[str]) -> None:
    for name in sorted(names):
        warnings.warn(f"{name} has no counterpart and is ignored")


def _depth(d) -> int:
    if d is None:
        return DEEPEST
    if int(d) > DEEPEST:
        raise ValueError(f"trees can be at most {DEEPEST} levels deep, not {d}")
    return int(d)


# Fixed names on the left; settings that reproduce the usual defaults below.
_FOREST_PARAMS = {
    "n_estimators": ("numTrees", int), "max_depth": ("maxDepth", _depth),
    "min_samples_leaf": ("minInstancesPerNode", int), "random_state": ("seed", int),
    "max_features": ("featureSubsetStrategy", _feature_share), "max_bins": ("maxBins", int),
}
_BOOSTING_PARAMS = {
    "n_estimators": ("maxIter", int), "learning_rate": ("stepSize", float),
    "max_depth": ("maxDepth", _depth), "min_samples_leaf": ("minInstancesPerNode", int),
    "subsample": ("subsamplingRate", float), "random_state": ("seed", int),
    "max_bins": ("maxBins", int),
}

_NETWORK_PARAMS = {
    "hidden_layer_sizes": ("hiddenLayers", lambda sizes: [int(s) for s in ([sizes] if isinstance(sizes, int) else sizes)]),
    "activation": ("activation", str), "alpha": ("alpha", float), "max_iter": ("maxIter", int), "tol": ("tol", float),
    "random_state": ("seed", int),
}

# Parameters that change the estimator.
MAPPED = {FOREST: set(_FOREST_PARAMS), BOOSTING: set(_BOOSTING_PARAMS), LINEAR: set(), RIDGE: {"alpha"},
          NETWORK: set(_NETWORK_PARAMS)}


def make_estimator(name: str, params: Mapping | None = None, *, n_rows: int = 0,
                   label_std: float = 0.0) -> Estimator:
    """Estimator for a model name. Ridge needs the size and spread of its training rows."""
    params = params or {}
    names = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
    if name == FOREST:
        settings = {"numTrees": USUAL_SIZE, "maxDepth": DEEPEST, "featureSubsetStrategy": "all",
                    "seed": 42} | _common(params, _FOREST_PARAMS)
        return RandomForestRegressor(**names, **settings)
    if name == BOOSTING:
        settings = {"maxIter": USUAL_SIZE, "stepSize": 0.1, "maxDepth": 3, "seed": 42} | _common(
            params, _BOOSTING_PARAMS)
        return GBTRegressor(**names, **settings)
    if name == LINEAR:
        _warn_of(set(params))
        return LinearRegression(**names, regParam=0.0, solver="normal")
    if name == RIDGE:
        _warn_of(set(params) - {"alpha"})
        # The solver divides the squared error by the rows and scales the label by
        # its population deviation, so the penalty is brought to the same footing.
        penalty = float(params.get("alpha", 1.0)) / max(n_rows, 1) * label_std
        return LinearRegression(**names, elasticNetParam=0.0, standardization=False,
                                regParam=penalty, solver="normal")
    if name == NETWORK:
        settings = _common(params, _NETWORK_PARAMS)
        return NetworkRegressor(**names, **settings)
    raise ValueError(f"unknown model {name!r}")


def task_rows(name: str, params: Mapping | None, features: int) -> int:
    """Rows that one task can keep while trees are fitted: the learner holds a count for each tree and a bin for each feature."""
    trees = int((params or {}).get(SIZE, USUAL_SIZE)) if name == FOREST else 1
    return max(1, TASK_BYTES // (ROW_BYTES + 4 * (trees + features)))


def grid_key(name: str, params: Mapping) -> tuple:
    """Trials that give the same estimator share a key and are fitted once."""
    used = MAPPED.get(name, set(params))
    # No limit of depth and the deepest tree there can be are one estimator.
    depth = lambda k, v: DEEPEST if k == "max_depth" and v is None and name in TREES else v
    return tuple(sorted((k, repr(depth(k, v))) for k, v in params.items() if k in used))
