import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.operators import combos, pruned

ROLES = Roles(target="y")


def gaps(spark, p, rows, seed, shares=None):
    rng = np.random.default_rng(seed)
    shares = shares if shares is not None else rng.uniform(0.3, 0.95, p)
    frame = pd.DataFrame({f"c{i}": np.where(rng.random(rows) < shares[i], 1.0, np.nan) for i in range(p)})
    frame["station_code"], frame["y"] = "S1", np.where(rng.random(rows) < 0.9, 1.0, np.nan)
    df = spark.createDataFrame(frame)
    return df.select("station_code", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame.columns if c != "station_code"])


@pytest.mark.parametrize("p, rows, n, sizes, beam", [(9, 200, 5, (1, 3, 4, 7), 5), (8, 25, 12, range(1, 9), 12), (6, 40, 3, (2,), 64)])
def test_equal_to_the_full_search(spark, p, rows, n, sizes, beam):
    df, names = gaps(spark, p, rows, p), [f"c{i}" for i in range(p)]
    want = combos.top_combinations(df, ROLES, names, sizes, n).orderBy("k", "rank").collect()
    got = pruned.pruned_combinations(df, ROLES, names, sizes, n, beam).best.orderBy("k", "rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_few_parts_are_followed(spark):
    """Thirty variables, eight of them nearly whole: of 8.7 million combinations of up to eight few are counted."""
    shares = np.array([0.97] * 8 + [0.25] * 22)
    df, names = gaps(spark, 30, 300, 3, shares), [f"c{i}" for i in range(30)]
    search = pruned.pruned_combinations(df, ROLES, names, (4, 8), 1)
    best = search.best.where("k = 8").first()
    assert best["combinacion"] == ", ".join(names[:8])
    assert best["filas_restantes"] == df.dropna(subset=["y", *names[:8]]).count()
    effort = {r["k"]: (r["counted"], r["followed"]) for r in search.effort.collect()}
    # Only the eight whole variables reach the cut, and these have 255 combinations.
    assert sorted(effort) == list(range(1, 9)) and sum(c for c, _ in effort.values()) <= 255
    assert all(effort[k + 1][0] <= 30 * effort[k][1] for k in range(1, 8))


def test_combinations_without_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "station_code string, y double, a double, b double, c double")
    for df in (none, none.unionByName(spark.createDataFrame([("S", 1.0, 1.0, None, None), ("S", None, 1.0, 1.0, 1.0)], none.schema))):
        for sizes in ((1, 2), (3, 9), ()):
            want = combos.top_combinations(df, ROLES, ["a", "b", "c"], sizes, 4).orderBy("k", "rank").collect()
            got = pruned.pruned_combinations(df, ROLES, ["a", "b", "c"], sizes, 4).best.orderBy("k", "rank").collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in want]
    with pytest.raises(ValueError):
        pruned.pruned_combinations(none, ROLES, [f"c{i}" for i in range(63)], (1,))
