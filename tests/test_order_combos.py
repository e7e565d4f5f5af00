from datetime import datetime, timedelta
from itertools import combinations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.operators import combos, ordering

START = datetime(2020, 1, 1)


def visits(spark, n, hot=0.5):
    """Half of all rows fall on one date."""
    rows = [(START if i < n * hot else START + timedelta(days=i % 37), f"s{i % 11}", i) for i in range(n)]
    return spark.createDataFrame(rows, "date timestamp_ntz, station_code string, id int").repartition(7)


def test_positions_follow_the_order_without_gaps(spark):
    rows = ordering.row_index(visits(spark, 5000), ["date", "station_code", "id"]).collect()
    rows.sort(key=lambda r: r["row_idx"])
    assert [r["row_idx"] for r in rows] == list(range(5000))
    keys = [(r["date"], r["station_code"], r["id"]) for r in rows]
    assert keys == sorted(keys)


def test_slices_are_the_positions(spark):
    table = ordering.sort_rows(visits(spark, 1000), ["date", "station_code", "id"])
    numbered = {r["id"]: r["row_idx"] for r in table.numbered().collect()}
    for first, end in [(0, 1000), (0, 1), (499, 502), (990, 2000), (1000, 1001), (7, 7)]:
        got = sorted(numbered[r["id"]] for r in table.slice(first, end).collect())
        assert got == list(range(first, min(end, 1000)))
    blocks = table.rows.groupBy(table.block([200, 700]).alias("b")).count().collect()
    assert {r["b"]: r["count"] for r in blocks} == {0: 200, 1: 500, 2: 300}


def test_an_empty_table_has_no_positions(spark):
    table = ordering.sort_rows(visits(spark, 10).where("false"), ["date"])
    assert table.n_rows == 0 and table.slice(0, 5).count() == 0


def test_a_slice_reaches_the_scan(spark):
    table = ordering.sort_rows(visits(spark, 1000), ["date", "id"])
    plan = table.slice(10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and f"GreaterThanOrEqual({ordering.MARK}" in plan


@given(n=st.integers(1, 500), splits=st.integers(2, 12))
@settings(max_examples=200, deadline=None)
def test_folds_chain_forward(n, splits):
    if n < splits + 1:
        with pytest.raises(ValueError):
            ordering.forward_folds(n, splits)
        return
    folds = ordering.forward_folds(n, splits)
    size = n // (splits + 1)
    assert len(folds) == splits and folds[-1].test_end == n
    for i, f in enumerate(folds):
        assert f.train_end == f.test_start and f.test_end - f.test_start == size
        assert f.test_start == n - (splits - i) * size
        if i:
            assert folds[i - 1].test_end == f.test_start
    assert folds[0].train_end >= size


def test_one_split_is_refused():
    with pytest.raises(ValueError):
        ordering.forward_folds(100, 1)


def test_ties_across_a_border_are_decided_by_the_key(spark):
    first = ordering.sort_rows(visits(spark, 600, hot=1.0), ["date", "station_code", "id"])
    again = ordering.sort_rows(visits(spark, 600, hot=1.0).repartition(3), ["date", "station_code", "id"])
    ids = lambda t: sorted(r["id"] for r in t.slice(100, 200).collect())
    assert ids(first) == ids(again)


def test_holdout_rounds_up(spark):
    df = spark.range(11).select(ordering.holdout_part(F.col("id"), 11).alias("p"))
    assert df.where("p = 'test'").count() == 3


def test_shuffled_folds_are_stable(spark):
    df = spark.range(2000)
    a = df.select("id", ordering.shuffled_fold(["id"], 5, 1).alias("f"))
    b = df.repartition(5).select("id", ordering.shuffled_fold(["id"], 5, 1).alias("f"))
    assert a.exceptAll(b).count() == 0
    sizes = [r["count"] for r in a.groupBy("f").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 300
    assert a.exceptAll(df.select("id", ordering.shuffled_fold(["id"], 5, 2).alias("f"))).count() > 0


def test_first_row_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("b", 5, None)], "k string, n int, t string")
    rows = sorted(tuple(r) for r in ordering.first_per_key(df, ["k"], ["n"]).collect())
    assert rows == [("a", 1, "z"), ("b", 5, None)]


VARS = [f"v{i}" for i in range(8)]


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(f"s{i % 9}", None if i % 13 == 0 else float(i % 50),
             *[None if (i * (v + 3)) % (v + 4) == 0 else float((i * v) % 10) for v in range(8)])
            for i in range(700)]
    df = spark.createDataFrame(rows, "station_code string, y double, " + ", ".join(f"{v} double" for v in VARS))
    return df.cache()


def brute(frame, k):
    out = []
    for combo in combinations(VARS, k):
        full = frame.dropna(subset=["y", *combo])
        out.append((", ".join(combo), len(full), full["station_code"].nunique()))
    # Most rows first; combinations come in lexicographic order, and sorting is stable.
    return sorted(out, key=lambda r: -r[1])


def test_combinations_equal_brute_force(gappy):
    frame = gappy.toPandas()
    roles = Roles(target="y")
    found = combos.top_combinations(gappy, roles, VARS, range(1, 9), n=100).collect()
    for k in range(1, 9):
        got = [(r["combinacion"], r["filas_restantes"]) for r in sorted(found, key=lambda r: r["rank"]) if r["k"] == k]
        assert got == [r[:2] for r in brute(frame, k)]


def test_tradeoff_equals_brute_force(gappy):
    frame = gappy.toPandas()
    rows = combos.tradeoff(gappy, Roles(target="y"), VARS, range(2, 8)).collect()
    assert {r["num_variables"]: tuple(r)[1:] for r in rows} == {k: brute(frame, k)[0] for k in range(2, 8)}


def test_superset_counts_cross_rounds(spark):
    # More bits than one round handles.
    p = combos.BITS_PER_ROUND + 3
    masks = [(1 << p) - 1, 0b100000001, 0b1, 0b110000000, 0b1]
    df = spark.createDataFrame([(m, 2) for m in masks], "mask bigint, n_rows bigint")
    found = {r["mask"]: r["n_rows"] for r in combos.superset_counts(df, p).collect()}
    for s in range(1 << p):
        assert found.get(s, 0) == sum(2 for m in masks if m & s == s)


def test_combinations_without_rows_are_listed(spark):
    df = spark.createDataFrame([("s", 1.0, None, None)], "station_code string, y double, a double, b double")
    rows = combos.top_combinations(df, Roles(target="y"), ["a", "b"], [1, 2]).collect()
    assert sorted((r["combinacion"], r["filas_restantes"]) for r in rows) == [("a", 0), ("a, b", 0), ("b", 0)]


def test_scores_weigh_rows_and_correlation(gappy):
    frame = gappy.toPandas()
    import numpy as np
    log_y = np.log1p(frame["y"])
    strength = {v: abs(frame[v].corr(log_y)) for v in VARS}
    rows = combos.scored_combinations(gappy, Roles(target="y"), VARS, (3, 4)).collect()
    want = []
    for k in (3, 4):
        for combo in combinations(VARS, k):
            known = [strength[c] for c in combo if strength[c] == strength[c]]
            want.append((", ".join(combo), len(frame.dropna(subset=["y", *combo])), float(np.mean(known))))
    n = [w[1] for w in want]
    c = [w[2] for w in want]
    for w, r in zip(sorted(want), sorted(rows, key=lambda r: r["combinacion_wq"])):
        assert (w[0], w[1]) == (r["combinacion_wq"], r["filas_restantes"])
        score = 0.5 * (w[1] - min(n)) / (max(n) - min(n)) + 0.5 * (w[2] - min(c)) / (max(c) - min(c))
        assert r["score_final"] == pytest.approx(score, abs=1e-9)


def test_elbow_of_a_sharp_bend(spark):
    curve = spark.createDataFrame([(1, 100), (2, 60), (3, 20), (4, 15), (5, 10), (6, 5), (7, 0)], "k int, rows int")
    rows = combos.elbow(curve, "k", "rows").where("is_elbow").collect()
    assert [r["k"] for r in rows] == [3]
    line = spark.createDataFrame([(i, 10 - i) for i in range(1, 8)], "k int, rows int")
    assert combos.elbow(line, "k", "rows").where("is_elbow").count() == 0
    flat = spark.createDataFrame([(1, 5)], "k int, rows int")
    assert combos.elbow(flat, "k", "rows").where("is_elbow").count() == 0


def test_few_sizes_of_many_variables(spark):
    from itertools import combinations

    from rillwater.config import Roles
    from rillwater.operators import combos

    names = [f"c{i}" for i in range(34)]
    rows = [[None if (r * 7 + i * 3) % 5 == 0 else 1.0 for i in range(34)] for r in range(25)]
    df = spark.createDataFrame([("s", 1.0, *r) for r in rows], "station_code string, target double, " + ", ".join(f"{n} double" for n in names))
    got = combos.top_combinations(df, Roles(target="target"), names, [1, 2], n=3).collect()
    for k in (1, 2):
        counts = [(sum(all(r[i] is not None for i in c) for r in rows), ", ".join(names[i] for i in c)) for c in combinations(range(34), k)]
        counts.sort(key=lambda x: -x[0])
        best = [(r["filas_restantes"], r["combinacion"]) for r in sorted(got, key=lambda r: r["rank"]) if r["k"] == k]
        assert best == counts[:3]
    with pytest.raises(ValueError):
        combos.combination_counts(spark.createDataFrame([(1, 1)], "mask long, n_rows long"), [f"c{i}" for i in range(63)], [1])
