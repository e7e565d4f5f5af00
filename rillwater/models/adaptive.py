"""Parameter search that learns from its trials: a tree-structured Parzen sampler.

The trials so far are split into a good part, the best ``share`` of them, and the rest. For each parameter
both parts get a density, a mixture of bell curves around their trials' values and one even curve over
the range. Candidates are drawn from the good density; the one whose values are most likely under
the good density and least under the other is tried next: the log ratios of its parameters add up.

History, candidates and scores are DataFrames, and the kernel sums are joins and aggregates. Trials are
proposed in batches, so that their fits run side by side; a trial that is proposed and not yet judged counts as
bad, which keeps the next proposal of the batch away from it. The same seed gives the same trials.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwater.operators.ordering import sort_rows
from rillwater.plans.keep import settle

Space = Mapping[str, tuple[int, int]]

SHARE = 0.25
CANDIDATES = 24


def bandwidth(low: Column, high: Column, n: Column) -> Column:
    """Width of the curves around n values of a range: a fifth of it, less with more values, one at least."""
    return F.greatest(F.lit(1.0), (high - low) / 5.0 / F.pow(F.greatest(n, F.lit(1)).cast("double"), F.lit(0.2)))


def split_history(history: DataFrame, share: float = SHARE) -> DataFrame:
    """``history`` (trial, parameter, value, score) with ``good``: whether a trial is among the best share of judged ones.

    Equal scores go by trial; a trial without score is pending and not good. At least one trial is good if any is judged.
    Places come from a range sort over all tasks, so a history may be of any size.
    """
    scores = history.where(F.col("score").isNotNull()).select("trial", "score").distinct()
    table = sort_rows(scores, [F.col("score").desc(), F.col("trial").asc_nulls_last()])
    places = table.numbered("place").groupBy("trial").agg(F.sum("place").alias("place"))
    good = places.where(F.col("place") < math.ceil(table.n_rows * share)).select("trial", F.lit(True).alias("good"))
    return history.join(good, "trial", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def kernel_sums(split: DataFrame, candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    """(parameter, value, low, high, n_good, n_bad, good, bad): sums of both parts' curves at every value of the candidates.

    ``split`` is (parameter, good, center). A curve depends on a value and a centre only, and both are whole numbers of a
    range: distinct values meet distinct centres, which carry how many trials they stand for. So the pairs grow with the
    ranges, not with candidates times trials.
    """
    centers = split.groupBy("parameter", "center", "good").agg(F.count("*").alias("trials"))
    sizes = ranges.join(centers.groupBy("parameter").agg(F.sum(F.when(F.col("good"), F.col("trials"))).alias("n_good"),
                                                         F.sum(F.when(~F.col("good"), F.col("trials"))).alias("n_bad")), "parameter", "left")
    sizes = sizes.na.fill(0, ["n_good", "n_bad"]).withColumns({
        "h_good": bandwidth(F.col("low"), F.col("high"), F.col("n_good")), "h_bad": bandwidth(F.col("low"), F.col("high"), F.col("n_bad"))})
    pairs = candidates.select("parameter", "value").distinct().join(sizes, "parameter").join(centers, "parameter", "left")
    h = F.when(F.col("good"), F.col("h_good")).otherwise(F.col("h_bad"))
    z = (F.col("value") - F.col("center")) / h
    curves = F.col("trials") * F.exp(-0.5 * z * z) / (h * math.sqrt(2 * math.pi))
    return pairs.groupBy("parameter", "value", "low", "high", "n_good", "n_bad").agg(
        F.coalesce(F.sum(F.when(F.col("good"), curves)), F.lit(0.0)).alias("good"), F.coalesce(F.sum(F.when(~F.col("good"), curves)), F.lit(0.0)).alias("bad"))


def candidate_scores(history: DataFrame, candidates: DataFrame, ranges: DataFrame, share: float = SHARE) -> DataFrame:
    """(candidate, score): log ratio of the densities, from (candidate, parameter, value) and (parameter, low, high).

    A part without trials has the even curve alone. The sums are measured and sent to the candidates if they are small. The planner
    judges candidates by the size of their files, so it is told not to send them, however small they look.
    """
    split = split_history(history, share).select("parameter", "good", F.col("value").alias("center"))
    at = settle(kernel_sums(split, candidates, ranges).withColumnsRenamed({"parameter": "at_parameter", "value": "at_value"}))
    rated = candidates.hint("merge").join(at, (F.col("parameter") == F.col("at_parameter")) & F.col("value").eqNullSafe(F.col("at_value")))
    # A candidate that states a parameter twice has the curves of both.
    sums = rated.groupBy("candidate", "parameter", "low", "high", "n_good", "n_bad").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    even = 1.0 / (F.col("high") - F.col("low") + 1)
    ratio = F.ln((F.col("good") + even) / (F.col("n_good") + 1)) - F.ln((F.col("bad") + even) / (F.col("n_bad") + 1))
    return sums.groupBy("candidate").agg(F.sum(ratio).alias("score"))


def draw_candidates(good: Sequence[Mapping[str, int]], space: Space, n: int, draw: random.Random) -> list[dict]:
    """Draws from the mixture of the good trials' curves and the even curve, whole numbers of the ranges."""
    found = []
    for _ in range(n):
        one = {}
        for name in sorted(space):
            low, high = space[name]
            at = draw.randrange(len(good) + 1)
            if at == len(good):
                one[name] = draw.randint(low, high)
            else:
                width = max(1.0, (high - low) / 5.0 / max(len(good), 1) ** 0.2)
                one[name] = min(high, max(low, round(draw.gauss(good[at][name], width))))
        found.append(one)
    return found


def long_rows(spark: SparkSession, trials: Sequence[Mapping[str, int]], key: str, scores: Sequence[float | None] | None = None) -> DataFrame:
    """(key, parameter, value[, score]) of the trials of a search."""
    rows = [(i, name, t[name], *(() if scores is None else (scores[i],))) for i, t in enumerate(trials) for name in sorted(t)]
    return spark.createDataFrame(rows, f"{key} int, parameter string, value int" + ("" if scores is None else ", score double"))


def propose(spark: SparkSession, space: Space, trials: Sequence[dict], scores: Sequence[float | None], n: int, seed: int,
            share: float = SHARE) -> list[dict]:
    """The next n trials after the given ones; scores are None where a trial is pending."""
    trials, scores, made = list(trials), list(scores), []
    ranges = spark.createDataFrame([(p, int(low), int(high)) for p, (low, high) in sorted(space.items())], "parameter string, low int, high int")
    for _ in range(n):
        draw = random.Random(f"{seed}/{len(trials)}")
        judged = sorted((i for i, s in enumerate(scores) if s is not None), key=lambda i: (-scores[i], i))
        good = [trials[i] for i in judged[:math.ceil(len(judged) * share)]]
        seen = {tuple(sorted(t.items())) for t in trials}
        candidates = draw_candidates(good, space, CANDIDATES, draw)
        # A trial is not made twice while others are at hand.
        candidates = [c for c in candidates if tuple(sorted(c.items())) not in seen] or candidates
        rated = candidate_scores(long_rows(spark, trials, "trial", scores), long_rows(spark, candidates, "candidate"), ranges, share)
        best = rated.orderBy(F.col("score").desc(), "candidate").first()["candidate"]
        trials.append(candidates[best])
        scores.append(None)
        made.append(candidates[best])
    return made
