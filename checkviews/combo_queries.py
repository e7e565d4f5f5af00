"""Search for the variable combinations that keep the most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checkviews.catalog import query, rounded
from checkviews.views import ROLES, VARIABLES, r, sql, wq
from rillwater.operators import combos, pruned

SIZES = (1, 2, 3, 4, 5, 6)
_P = len(VARIABLES)
_mask = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN {1 << (_P - 1 - i)} ELSE 0 END"
                   for i, v in enumerate(VARIABLES))
_names = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN s & {1 << (_P - 1 - i)} <> 0 THEN '{v}' END" for i, v in enumerate(VARIABLES)) + ")"

MASKS = f"masks AS (SELECT station_code, {_mask} AS m FROM wq WHERE target IS NOT NULL)"
COUNTS = f"""counts AS (SELECT s, bit_count(CAST(s AS BIGINT)) AS k, count(m) AS n FROM range(1, {1 << _P}) t(s)
 LEFT JOIN masks ON m & s = s GROUP BY s)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, s DESC) AS place FROM counts)"
BEST = f"""best AS (SELECT CAST(k AS BIGINT) AS num_variables, {_names} AS mejor_combinacion, n AS filas_maximas,
 (SELECT count(DISTINCT station_code) FROM masks WHERE m & s = s) AS estaciones_restantes
 FROM ranked WHERE place = 1)"""


@query("combo_topk", sql("wq", MASKS, COUNTS, RANKED, f"""
SELECT CAST(k AS BIGINT) AS k, place AS rank, {_names} AS combinacion, n AS filas_restantes
FROM ranked WHERE place <= 10"""))
def combo_topk(spark, sf_dir):
    return rounded(combos.top_combinations(wq(spark, sf_dir), ROLES, VARIABLES, SIZES))


@query("combo_tradeoff", sql("wq", MASKS, COUNTS, RANKED, BEST, "SELECT * FROM best"))
def combo_tradeoff(spark, sf_dir):
    return rounded(combos.tradeoff(wq(spark, sf_dir), ROLES, VARIABLES, SIZES))


@query("combo_elbow", sql("wq", MASKS, COUNTS, RANKED, BEST, """scaled AS (
 SELECT num_variables AS x, filas_maximas AS y,
  (num_variables - min(num_variables) OVER ()) / CAST(max(num_variables) OVER () - min(num_variables) OVER () AS DOUBLE) AS xu,
  (filas_maximas - min(filas_maximas) OVER ()) / CAST(max(filas_maximas) OVER () - min(filas_maximas) OVER () AS DOUBLE) AS yu,
  1.0 / (count(*) OVER () - 1) AS step FROM best)""", """curve AS (SELECT *, 1 - yu - xu AS d FROM scaled)""", """
 peaks AS (SELECT *, coalesce(d >= lag(d) OVER (ORDER BY x) AND d >= lead(d) OVER (ORDER BY x), false) AS is_peak FROM curve)""", """
 runs AS (SELECT *, sum(CAST(is_peak AS INTEGER)) OVER (ORDER BY x) AS run, CASE WHEN is_peak THEN d - step END AS threshold FROM peaks)""", """
 knees AS (SELECT *, is_peak AND coalesce(min(CASE WHEN NOT is_peak THEN d END) OVER (PARTITION BY run) < threshold, false) AS is_knee FROM runs)""", f"""
SELECT x AS num_variables, y AS filas_maximas, {r('xu')} AS x_unit, {r('yu')} AS y_unit, {r('d')} AS distance, is_peak,
 {r('threshold')} AS threshold, coalesce(x = (SELECT min(x) FROM knees WHERE is_knee), false) AS is_elbow FROM knees"""))
def combo_elbow(spark, sf_dir):
    curve = combos.tradeoff(wq(spark, sf_dir), ROLES, VARIABLES, SIZES)
    return rounded(combos.elbow(curve, "num_variables", "filas_maximas"))


_strength = ", ".join(f"abs(corr({v}, ln(1 + target))) AS c{i}" for i, v in enumerate(VARIABLES))
_mean = "(" + " + ".join(f"CASE WHEN s & {1 << (_P - 1 - i)} <> 0 THEN c{i} ELSE 0 END"
                         for i in range(_P)) + ") / k"


@query("combo_score", sql("wq", MASKS, COUNTS, f"strength AS (SELECT {_strength} FROM wq)", f"""
 rated AS (SELECT s, k, n, {_mean} AS c FROM counts, strength WHERE k BETWEEN 2 AND 5)""", """
 scored AS (SELECT *, (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) AS nu,
  (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS cu FROM rated)""", f"""
SELECT CAST(k AS BIGINT) AS num_variables_wq, {_names} AS combinacion_wq, n AS filas_restantes,
 {r('c', 6)} AS correlacion_promedio_wq, {r('nu', 6)} AS filas_norm, {r('cu', 6)} AS corr_norm,
 {r('0.5 * nu + 0.5 * cu', 6)} AS score_final FROM scored
ORDER BY 0.5 * nu + 0.5 * cu DESC, combinacion_wq LIMIT 15"""))
def combo_score(spark, sf_dir):
    scored = combos.scored_combinations(wq(spark, sf_dir), ROLES, VARIABLES, (2, 3, 4, 5))
    return rounded(combos.best_scores(scored), 6)


# Fourteen variables, of which pairs and triples are sought.
_MANY = tuple(f"c{i}" for i in range(14))
_gap = lambda i: f"(l_partkey * {i + 3} + l_linenumber * {2 * i + 1}) % {i % 5 + 2}"
_many_mask = " + ".join(f"CASE WHEN {_gap(i)} <> 0 THEN {1 << (13 - i)} ELSE 0 END" for i in range(14))
_many_names = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN s & {1 << (13 - i)} <> 0 THEN '{v}' END" for i, v in enumerate(_MANY)) + ")"


@query("combo_topk_many", sql("wq", f"""
 masks AS (SELECT {_many_mask} AS m, count(*) AS n FROM wq WHERE target IS NOT NULL GROUP BY 1)""", """
 wanted AS (SELECT s, bit_count(CAST(s AS BIGINT)) AS k FROM range(1, 16384) t(s) WHERE bit_count(CAST(s AS BIGINT)) IN (2, 3))""", """
 counts AS (SELECT s, k, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM wanted LEFT JOIN masks ON m & s = s GROUP BY s, k)""", RANKED, f"""
SELECT CAST(k AS BIGINT) AS k, place AS rank, {_many_names} AS combinacion, n AS filas_restantes FROM ranked WHERE place <= 10"""))
def combo_topk_many(spark, sf_dir):
    rows = wq(spark, sf_dir)
    rows = rows.select("station_code", "target", *[F.when(F.expr(_gap(i)) != 0, 1.0).alias(v) for i, v in enumerate(_MANY)])
    return rounded(combos.top_combinations(rows, ROLES, _MANY, (2, 3)))


# Forty variables: fourteen that most rows have among others that few have. The SQL counts through the combinations of
# the fourteen; its last condition proves that none with another variable could be among the best.
_GOOD, _WIDE = 14, 40
_wide = tuple(f"d{i}" for i in range(_WIDE))
_wide_gap = lambda i: (f"(l_orderkey * {i + 1} + l_partkey) % {29 + 2 * i} <> 0" if i < _GOOD
                       else f"(l_orderkey + l_partkey * {i}) % {5 + i % 3} = 0")
_good_mask = " + ".join(f"CASE WHEN {_wide_gap(i)} THEN {1 << (_GOOD - 1 - i)} ELSE 0 END" for i in range(_GOOD))
_good_names = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN s & {1 << (_GOOD - 1 - i)} <> 0 THEN '{v}' END" for i, v in enumerate(_wide[:_GOOD])) + ")"
_poor = ", ".join(f"count(CASE WHEN {_wide_gap(i)} THEN 1 END)" for i in range(_GOOD, _WIDE))


@query("combo_topk_wide", sql("wq", f"""
 masks AS (SELECT {_good_mask} AS m, count(*) AS n FROM wq WHERE target IS NOT NULL GROUP BY 1)""", f"""
 wanted AS (SELECT s, bit_count(CAST(s AS BIGINT)) AS k FROM range(1, {1 << _GOOD}) t(s) WHERE bit_count(CAST(s AS BIGINT)) BETWEEN 2 AND 10)""", """
 counts AS (SELECT s, k, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM wanted LEFT JOIN masks ON m & s = s GROUP BY s, k)""", RANKED, f"""
 poor AS (SELECT greatest({_poor}) AS n FROM wq WHERE target IS NOT NULL)""", f"""
SELECT CAST(k AS BIGINT) AS k, place AS rank, {_good_names} AS combinacion, n AS filas_restantes FROM ranked
WHERE place <= 10 AND n > (SELECT n FROM poor)"""))
def combo_topk_wide(spark, sf_dir):
    """The best of 1.2 billion combinations of up to ten variables out of forty."""
    rows = wq(spark, sf_dir)
    rows = rows.select("station_code", "target", *[F.when(F.expr(_wide_gap(i)), 1.0).alias(v) for i, v in enumerate(_wide)])
    return rounded(pruned.pruned_combinations(rows, ROLES, _wide, range(2, 11)).best)
