import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rillwater.models import adaptive, network
from rillwater.models.registry import FOREST, LABEL, NETWORK, PREDICTION, RIDGE, grid_key
from rillwater.models.search import adaptive_search, random_trials
from rillwater.models.validation import convergence, fit_model, predict
from rillwater.operators.ordering import sort_rows
from rillwater.sources import sinks

SPACE = {"a": (0, 200), "b": (1, 40)}


def density_ratio(history, candidate, space, share=0.25):
    judged = sorted((h for h in history if h[1] is not None), key=lambda h: (-h[1], h[0]))
    good = {h[0] for h in judged[:math.ceil(len(judged) * share)]}
    total = 0.0
    for name, (low, high) in space.items():
        logs = []
        for part in (True, False):
            centers = [h[2][name] for h in history if (h[0] in good) == part]
            width = max(1.0, (high - low) / 5 / max(len(centers), 1) ** 0.2)
            bells = sum(math.exp(-0.5 * ((candidate[name] - c) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for c in centers)
            logs.append(math.log((bells + 1 / (high - low + 1)) / (len(centers) + 1)))
        total += logs[0] - logs[1]
    return total


def test_scores_equal_the_formula_with_pending_and_tied_trials(spark):
    rng = random.Random(1)
    history = [(i, rng.choice([None, 0.5, rng.random()]), {"a": rng.randint(0, 200), "b": rng.randint(1, 40)}) for i in range(23)]
    candidates = [{"a": rng.randint(0, 200), "b": rng.randint(1, 40)} for _ in range(30)]
    ranges = spark.createDataFrame([(p, *r) for p, r in SPACE.items()], "parameter string, low int, high int")
    for rows in (history, [(i, None, t) for i, _, t in history]):
        long = adaptive.long_rows(spark, [h[2] for h in rows], "trial", [h[1] for h in rows])
        got = adaptive.candidate_scores(long, adaptive.long_rows(spark, candidates, "candidate"), ranges).collect()
        assert {r["candidate"]: round(r["score"], 9) for r in got} == {i: round(density_ratio(rows, c, SPACE), 9) for i, c in enumerate(candidates)}


def joined_rows(plan):
    """Rows that all joins of an executed plan gave."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    found = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.getClass().getSimpleName() else 0
    return own + sum(joined_rows(found.apply(i)) for i in range(found.size()))


def test_work_grows_with_the_ranges_not_with_candidates_times_trials(spark):
    """3,000 candidates, some twice, some without a value, and 400 trials: the scores of the formula from few pairs."""
    rng = random.Random(2)
    history = [(i, rng.choice([None, rng.random()]), {"a": rng.randint(0, 20), "b": rng.randint(1, 9)}) for i in range(400)]
    space = {"a": (0, 20), "b": (1, 9)}
    candidates = [{"a": i % 21, "b": 1 + i % 9} for i in range(3000)]
    ranges = spark.createDataFrame([(p, *r) for p, r in space.items()], "parameter string, low int, high int")
    long = adaptive.long_rows(spark, [h[2] for h in history], "trial", [h[1] for h in history])
    odd = spark.createDataFrame([(-1, "a", None), (-1, "b", 3), (None, "a", 5), (-2, "a", 4), (-2, "a", 4)], "candidate int, parameter string, value int")
    scored = adaptive.candidate_scores(long, adaptive.long_rows(spark, candidates, "candidate").union(odd), ranges)
    got = {r["candidate"]: r["score"] for r in scored.collect()}
    assert len(got) == 3003
    for i in (0, 1, 17, 2999):
        assert got[i] == pytest.approx(density_ratio(history, candidates[i], space), abs=1e-9)
    assert got[None] == pytest.approx(density_ratio(history, {"a": 5}, {"a": (0, 20)}), abs=1e-9)
    assert joined_rows(scored._jdf.queryExecution().executedPlan()) < 50_000  # 2.4 million before


def planted(t):
    return -((t["a"] - 37) / 60) ** 2 - ((t["b"] - 30) / 12) ** 2


def sent_columns(plan):
    """Columns of all tables that a plan sends to every executor."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return sent_columns(plan.executedPlan())
    own = {plan.output().apply(i).name() for i in range(plan.output().size())} if plan.getClass().getSimpleName() == "BroadcastExchangeExec" else set()
    return own.union(*[sent_columns(plan.children().apply(i)) for i in range(plan.children().size())])


def test_candidates_are_never_sent_around(spark):
    """Their size is a guess from the files they come from; the sums are measured."""
    history = adaptive.long_rows(spark, [{"a": i, "b": 1 + i % 40} for i in range(50)], "trial", [i / 50 for i in range(50)])
    candidates = spark.range(2000).selectExpr("cast(id as int) candidate", "inline(array(struct('a' parameter, cast(id % 201 as int) value), struct('b' parameter, cast(1 + id % 40 as int) value)))")
    ranges = spark.createDataFrame([(p, *r) for p, r in SPACE.items()], "parameter string, low int, high int")
    scored = adaptive.candidate_scores(history, candidates, ranges)
    sent = sent_columns(scored._jdf.queryExecution().executedPlan())
    assert "at_value" in sent and "candidate" not in sent
    assert scored.count() == 2000


def test_learns_from_its_trials(spark):
    """At equal trials it finds better ones than random draws, and the same ones again."""
    ours, chance = [], []
    for seed in (1, 2, 3):
        trials = random_trials(SPACE, 8, seed)
        while len(trials) < 20:
            more = adaptive.propose(spark, SPACE, trials, [planted(t) for t in trials], 4, seed)
            assert len({tuple(t.values()) for t in more}) == 4 and all(SPACE[k][0] <= v <= SPACE[k][1] for t in more for k, v in t.items())
            trials += more
        ours.append(max(map(planted, trials)))
        chance.append(max(map(planted, random_trials(SPACE, 20, seed))))
    assert np.mean(ours) > np.mean(chance)
    again = random_trials(SPACE, 8, 3)
    assert adaptive.propose(spark, SPACE, again, [planted(t) for t in again], 4, 3) == trials[8:12]


def test_a_whole_adaptive_search(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 > 9).cast("double").alias(LABEL))
    table = sort_rows(rows, ["id"])
    found = adaptive_search(table, ["x"], FOREST, {"n_estimators": (2, 4), "max_depth": (1, 3)}, n_trials=6, splits=2, startup=3, parallelism=2)
    trials = found.trials.collect()
    assert len(trials) == 6 and found.best_score == max(r["mean_r2"] for r in trials) > 0.99
    ridge = adaptive_search(table, ["x"], RIDGE, {"alpha": (0, 1000)}, n_trials=7, splits=2, startup=3)
    assert ridge.trials.count() == 7 and 0 <= ridge.best_params["alpha"] <= 1000


@pytest.mark.parametrize("activation", sorted(network.ACTIVATIONS))
def test_gradients(activation):
    draw, sizes = np.random.default_rng(5), [3, 4, 2, 1]
    x, y = draw.normal(size=(20, 3)), draw.normal(size=20)
    w = network.start_weights(sizes, activation, 7)
    _, gradient = network.loss_and_gradient(w, sizes, activation, x, y)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        up, down = (network.loss_and_gradient(w + s, sizes, activation, x, y)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[k]) < 1e-4 * max(1.0, abs(gradient[k]))


def test_sums_meet_by_tree(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(60, 2)), draw.normal(size=60)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(9)
    sizes = [2, 5, 1]
    w = network.start_weights(sizes, "tanh", 1)
    loss, gradient = network.loss_and_gradient(w, sizes, "tanh", x, y)
    for fan in (64, 2):
        monkeypatch.setattr(network, "FAN", fan)
        n, found, sums = network.summed(rows, w, sizes, "tanh")
        assert n == 60 and abs(found - loss) < 1e-9 and np.allclose(sums, gradient)


def test_learns_a_bend_stops_early_and_is_saved(spark, tmp_path):
    rows = spark.range(300).select(F.col("id"), ((F.col("id") - 150) / 50.0).alias("x"), F.abs((F.col("id") - 150) / 50.0).alias(LABEL))
    settings = {"hidden_layer_sizes": (8,), "activation": "relu", "max_iter": 150}
    model = fit_model(rows, ["x"], NETWORK, settings)
    found = predict(model, rows).agg(F.max(F.abs(F.col(PREDICTION) - F.col(LABEL)))).first()[0]
    assert found < 0.2
    sinks.save_model(model, str(tmp_path / "m"), ["x"])
    loaded, features = sinks.load_model(spark, str(tmp_path / "m"))
    assert isinstance(loaded, PipelineModel) and features == ["x"] and convergence(loaded) == convergence(model)
    apart = predict(loaded, rows).join(predict(model, rows).withColumnRenamed(PREDICTION, "other"), "id").agg(F.max(F.abs(F.col(PREDICTION) - F.col("other"))))
    assert apart.first()[0] < 1e-12
    assert convergence(fit_model(rows, ["x"], NETWORK, settings | {"max_iter": 2})) == "Not Converged"
    assert convergence(fit_model(rows, ["x"], NETWORK, {"hidden_layer_sizes": (), "activation": "identity"})) == "OK"


def test_one_estimator_one_key():
    assert grid_key(FOREST, {"max_depth": None}) == grid_key(FOREST, {"max_depth": 30})
    assert grid_key(NETWORK, {"alpha": 0.1}) != grid_key(NETWORK, {"alpha": 0.2})
