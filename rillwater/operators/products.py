"""Sums of products of many columns from one scan.

Tasks read the columns in Arrow blocks and add up matrix products of the values and of their presence;
matrices of many tasks are added up in parts of a size that the engine picks, so few reach the driver,
each the square of the number of columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python workers need not have the package: its functions are shipped by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "block int, sums binary"


@dataclass
class Products:
    """Sums over the rows in which both variables of a pair are present.

    With ``last_only`` the second variable of every pair is the last column.
    """

    both: np.ndarray    # rows with i and j
    product: np.ndarray  # sum of x_i * x_j
    first: np.ndarray   # sum of x_i where j is present
    square: np.ndarray  # sum of x_i^2 where j is present
    other: np.ndarray   # sum of x_j where i is present
    other_square: np.ndarray  # sum of x_j^2 where i is present


def _sums(x: np.ndarray, last_only: bool) -> np.ndarray:
    """The six tables of rows x columns values, NaN where absent."""
    there = ~np.isnan(x)
    x, there = np.where(there, x, 0.0), there.astype(float)
    square, y, y_there = x * x, x[:, -1:] if last_only else x, there[:, -1:] if last_only else there
    return np.stack([there.T @ y_there, x.T @ y, x.T @ y_there, square.T @ y_there, there.T @ y, there.T @ (y * y)])


def cross_products(df: DataFrame, columns: Sequence[Column], block: Column | None = None, last_only: bool = False) -> dict[int, Products]:
    """Products of the columns per block (block 0 when none is given). NaN counts as absent."""
    p = len(columns)
    shape = (6, p, 1 if last_only else p)
    rows = df.select((F.lit(0) if block is None else block).cast("int").alias("block"),
                     *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def handed(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())],
                                          names=["block", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(p)], axis=1).astype(float)
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            for b in np.unique(numbers):
                own = x if (numbers == b).all() else x[numbers == b]
                found[int(b)] = found.get(int(b), 0.0) + _sums(own, last_only)
        yield handed(found)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[b] = found.get(b, 0.0) + np.frombuffer(sums.as_py()).reshape(shape)
        yield handed(found)

    # Matrices of many tasks are brought together in parts of like size before the driver sees them.
    sums = rows.mapInArrow(partial, SCHEMA).hint("rebalance").mapInArrow(added, SCHEMA)
    filled: dict[int, np.ndarray] = {}
    for r in sums.collect():  # a row for each part and block
        filled[r["block"]] = filled.get(r["block"], 0.0) + np.frombuffer(r["sums"]).reshape(shape)
    return {b: Products(*v) for b, v in filled.items()}


def means(df: DataFrame, columns: Sequence[Column]) -> list[float]:
    """Mean of each column, zero where it has no value."""
    row = df.agg(*[F.avg(c.cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [m or 0.0 for m in row]
