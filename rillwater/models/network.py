"""A feed-forward network regressor, fitted on all tasks at once.

Every round the weights go out with the tasks, each task adds up the loss and the gradient of its rows in
numpy, and the sums meet by tree; only they reach the driver, which makes one step of L-BFGS with a
backtracking line search. The rows are stored once before the first round, so a round is one scan of them.

The loss is half the mean squared error plus half ``alpha`` / rows times the squared weights (not the
offsets). A fit ends when no gradient exceeds ``tol`` or the loss no longer falls (``converged``), or
after ``max_iter`` steps (not converged). Without hidden layers, or with ``identity``, it is linear regression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.plans.keep import store

# Sums that one task, or the driver, adds up.
FAN = 64
MEMORY = 10

ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {  # value, and slope in terms of the value
    "identity": (lambda z: z, lambda a: np.ones_like(a)),
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (lambda z: 0.5 * (1 + np.tanh(0.5 * z)), lambda a: a * (1 - a)),
}


def unpack(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, offsets) of each layer from one flat array."""
    layers, at = [], 0
    for rows, columns in zip(sizes, sizes[1:]):
        layers.append((weights[at:at + rows * columns].reshape(rows, columns), weights[at + rows * columns:at + (rows + 1) * columns]))
        at += (rows + 1) * columns
    return layers


def start_weights(sizes: Sequence[int], activation: str, seed: int) -> np.ndarray:
    """Uniform draws whose spread keeps the layers' signals alike."""
    draw, parts = np.random.default_rng(seed), []
    for rows, columns in zip(sizes, sizes[1:]):
        bound = np.sqrt((2.0 if activation == "logistic" else 6.0) / (rows + columns))
        parts.append(draw.uniform(-bound, bound, (rows + 1) * columns))
    return np.concatenate(parts)


def forward(weights: np.ndarray, sizes: Sequence[int], activation: str, x: np.ndarray) -> list[np.ndarray]:
    """Values of all layers, the input first."""
    act, values = ACTIVATIONS[activation][0], [x]
    layers = unpack(weights, sizes)
    for k, (matrix, offsets) in enumerate(layers):
        z = values[-1] @ matrix + offsets
        values.append(z if k == len(layers) - 1 else act(z))
    return values


def loss_and_gradient(weights: np.ndarray, sizes: Sequence[int], activation: str, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the squared error summed over the rows, and its gradient."""
    slope = ACTIVATIONS[activation][1]
    values, layers = forward(weights, sizes, activation, x), unpack(weights, sizes)
    error = values[-1][:, 0] - y
    delta, parts = error[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(values[k].T @ delta).ravel(), delta.sum(axis=0)]))
        if k:
            delta = (delta @ layers[k][0].T) * slope(values[k])
    return float(0.5 * error @ error), np.concatenate(parts[::-1])


def _penalised(sizes: Sequence[int]) -> np.ndarray:
    """1 for the weights, 0 for the offsets."""
    return np.concatenate([np.concatenate([np.ones(rows * columns), np.zeros(columns)]) for rows, columns in zip(sizes, sizes[1:])])


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def summed(rows: DataFrame, weights: np.ndarray, sizes: Sequence[int], activation: str) -> tuple[int, float, np.ndarray]:
    """Rows, loss and gradient over all rows of (x, y)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros(len(weights))
        for batch in batches:
            more, step = loss_and_gradient(weights, sizes, activation, _matrix(batch.column(0), sizes[0]),
                                           batch.column(1).to_numpy(zero_copy_only=False))
            n, loss, gradient = n + batch.num_rows, loss + more, gradient + step
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([gradient.tobytes()])], names=["n", "loss", "gradient"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros(len(weights))
        for batch in batches:
            n, loss = n + sum(batch.column(0).to_pylist()), loss + sum(batch.column(1).to_pylist())
            for part in batch.column(2):
                gradient = gradient + np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([gradient.tobytes()])], names=["n", "loss", "gradient"])

    schema = "n bigint, loss double, gradient binary"
    sums, parts = rows.mapInArrow(partial, schema), rows.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(added, schema)
    n, loss, gradient = 0, 0.0, np.zeros(len(weights))
    for r in sums.collect():  # at most FAN rows, each the size of the network
        n, loss, gradient = n + r["n"], loss + r["loss"], gradient + np.frombuffer(r["gradient"])
    return n, loss, gradient


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int, bool, list[float]]:
    """(weights, steps, whether it converged, losses) by limited-memory BFGS with backtracking."""
    w = start
    loss, gradient = evaluate(w)
    losses, steps, changes = [loss], 0, []
    while steps < max_iter:
        if np.abs(gradient).max(initial=0.0) <= tol:
            return w, steps, True, losses
        direction, used = -gradient, []
        for s, d in reversed(changes):
            a = (s @ direction) / (s @ d)
            direction = direction - a * d
            used.append(a)
        if changes:
            s, d = changes[-1]
            direction = direction * ((s @ d) / (d @ d))
        else:
            direction = direction / max(1.0, float(np.linalg.norm(gradient)))
        for (s, d), a in zip(changes, reversed(used)):
            direction = direction + s * (a - (d @ direction) / (s @ d))
        fall, length = float(gradient @ direction), 1.0
        if fall >= 0:
            changes = []
            direction, fall = -gradient, -float(gradient @ gradient)
        while True:
            there, slope = evaluate(w + length * direction)
            if there <= loss + 1e-4 * length * fall:
                break
            length /= 2
            if length < 1e-8:
                return w, steps, True, losses  # no way down: as low as rounding allows
        s, d = length * direction, slope - gradient
        if s @ d > 1e-12 * (d @ d):
            changes = [*changes[-MEMORY + 1:], (s, d)]
        w, before, loss, gradient = w + s, loss, there, slope
        steps += 1
        losses.append(loss)
        if before - loss <= 1e-12 * max(abs(before), 1.0):
            return w, steps, True, losses
    return w, steps, bool(np.abs(gradient).max(initial=0.0) <= tol), losses


class _NetworkParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasTol, HasSeed):
    hiddenLayers = Param(Params._dummy(), "hiddenLayers", "units of each hidden layer", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "identity, relu, tanh or logistic", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty on squared weights", TypeConverters.toFloat)
    sizes = Param(Params._dummy(), "sizes", "units of all layers of a fitted network", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "weights of a fitted network", TypeConverters.toListFloat)
    steps = Param(Params._dummy(), "steps", "steps that the fit took", TypeConverters.toInt)
    converged = Param(Params._dummy(), "converged", "whether the fit ended before its last step", TypeConverters.toBoolean)


class NetworkModel(Model, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted network; ``converged`` tells how the fit ended."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes, weights = self.getOrDefault(self.sizes), np.array(self.getOrDefault(self.weights))
        activation, features = self.getOrDefault(self.activation), self.getFeaturesCol()

        @F.pandas_udf("double")
        def predicted(rows):
            import pandas as pd

            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, sizes[0]))
            return pd.Series(forward(weights, sizes, activation, x)[-1][:, 0])

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(features))))


class NetworkRegressor(Estimator, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", hiddenLayers=(100,), activation="relu",
                 alpha=0.0001, maxIter=200, tol=1e-5, seed=42):
        super().__init__()
        self._set(**{k: list(v) if k == "hiddenLayers" else v for k, v in {
            "featuresCol": featuresCol, "labelCol": labelCol, "predictionCol": predictionCol, "hiddenLayers": hiddenLayers,
            "activation": activation, "alpha": alpha, "maxIter": maxIter, "tol": tol, "seed": seed}.items()})
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {activation!r}")

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        rows = store(dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
                                    F.col(self.getLabelCol()).cast("double").alias("y")), "network-rows")
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit a network on")
        sizes = [len(first["x"]), *self.getOrDefault(self.hiddenLayers), 1]
        activation, alpha, free = self.getOrDefault(self.activation), self.getOrDefault(self.alpha), _penalised(sizes)

        def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
            n, loss, gradient = summed(rows, w, sizes, activation)
            return (loss + 0.5 * alpha * float((free * w) @ w)) / n, (gradient + alpha * free * w) / n

        w, steps, converged, _ = minimise(evaluate, start_weights(sizes, activation, self.getSeed()), self.getMaxIter(), self.getTol())
        model = NetworkModel()
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), activation=activation, sizes=sizes,
                   weights=w.tolist(), steps=steps, converged=converged)
        return model
