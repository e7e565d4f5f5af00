"""Linear models for all folds and penalties from one scan of the data.

Forward-chaining folds are nested blocks of time. Sums of products per block are
enough to fit every fold (running sums over blocks) for any penalty and to score
it on the next block, so a search over penalties costs no further scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from rillwater.models.registry import LABEL, LINEAR, RIDGE
from rillwater.operators.ordering import SortedTable, forward_folds
from rillwater.operators.products import cross_products, means

@dataclass
class Moments:
    """Sums over rows of z = (1, x - centre, y - centre): z'z."""

    cross: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.cross + other.cross)

    @property
    def n(self) -> float:
        return float(self.cross[0, 0])

    def fit(self, alpha: float = 0.0) -> np.ndarray:
        """Intercept and weights; the intercept is not penalised."""
        p = len(self.cross) - 2
        xs, ys = slice(1, p + 1), p + 1
        mean_x, mean_y = self.cross[0, xs] / self.n, self.cross[0, ys] / self.n
        gram = self.cross[xs, xs] - self.n * np.outer(mean_x, mean_x)
        moment = self.cross[xs, ys] - self.n * mean_x * mean_y
        if alpha > 0:
            weights = np.linalg.solve(gram + alpha * np.eye(p), moment)
        else:
            weights = np.linalg.lstsq(gram, moment, rcond=None)[0]
        return np.concatenate([[mean_y - weights @ mean_x], weights])

    def score(self, coefficients: np.ndarray, centre_y: float) -> dict[str, float | None]:
        """Scores of a fitted model on the rows behind these sums."""
        r = np.concatenate([coefficients, [-1.0]])  # prediction minus observation
        sse = float(r @ self.cross @ r)
        bias = float(r @ self.cross[:, 0])
        sum_y = float(self.cross[0, -1])
        sst = float(self.cross[-1, -1]) - sum_y * sum_y / self.n
        observed = sum_y + self.n * centre_y
        skill = 1 - sse / sst if sst > 0 else None
        return {
            "R2_log": skill if skill is not None else (1.0 if sse <= 0 else 0.0),
            "RMSE_log": float(np.sqrt(max(sse, 0.0) / self.n)),
            "PBIAS_log": float(100 * bias / observed) if observed else None,
            "NSE_log": skill,
        }


def block_moments(table: SortedTable, features: Sequence[str],
                  splits: int) -> tuple[list[Moments], np.ndarray]:
    """Sums of products per block, and the centres they are taken around."""
    columns = [F.col(f"`{c}`") for c in [*features, LABEL]]
    centre = means(table.rows, columns)
    z = [F.lit(1.0)] + [c - F.lit(m) for c, m in zip(columns, centre)]
    cuts = [f.test_start for f in forward_folds(table.n_rows, splits)]
    found = cross_products(table.rows, z, table.block(cuts))
    empty = np.zeros((len(z), len(z)))
    return [Moments(found[b].product if b in found else empty)
            for b in range(splits + 1)], np.array(centre)


def score_penalties(table: SortedTable, features: Sequence[str], splits: int,
                    alphas: Sequence[float]) -> list[list[dict]]:
    """Fold scores for every penalty."""
    blocks, centre = block_moments(table, features, splits)
    scores = [[] for _ in alphas]
    train = blocks[0]
    for test in blocks[1:]:
        for k, alpha in enumerate(alphas):
            scores[k].append(test.score(train.fit(alpha), centre[-1]))
        train = train + test
    return scores


def penalty_of(name: str, params: Mapping | None) -> float | None:
    """Penalty of a linear model; None for models that sums of products cannot fit."""
    if name == LINEAR:
        return 0.0
    return float((params or {}).get("alpha", 1.0)) if name == RIDGE else None
