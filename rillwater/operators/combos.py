"""Which variables to keep: rows that remain for every combination of them.

The data is scanned once. Each row becomes a bit mask of the variables it has;
a combination fits a row when all its bits are in the mask. Counting masks and
then adding up supersets replaces one scan of the data per combination.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.functions.numbers import min_max, total
from rillwater.operators.correlation import target_correlation
from rillwater.plans.keep import cached, store

# Bits handled per round when adding up supersets: a mask yields at most 2^6 rows.
BITS_PER_ROUND = 6
# Masks are signed 64-bit numbers.
MASK_BITS = 62


def _bit(variables: Sequence[str], position: int) -> int:
    # First variable, highest bit: among equal sizes, a larger mask comes first
    # in lexicographic order of the combinations.
    return 1 << (len(variables) - 1 - position)


def present_mask(variables: Sequence[str]) -> Column:
    return total([F.when(F.col(v).isNotNull(), F.lit(_bit(variables, i)).cast("bigint"))
                  .otherwise(F.lit(0).cast("bigint")) for i, v in enumerate(variables)])


def mask_names(mask: Column, variables: Sequence[str]) -> Column:
    """Names of the variables in a mask, joined by a comma and a blank."""
    return F.concat_ws(", ", *[
        F.when(mask.bitwiseAND(F.lit(_bit(variables, i)).cast("bigint")) != 0, v)
        for i, v in enumerate(variables)])


def station_masks(df: DataFrame, roles: Roles, variables: Sequence[str]) -> DataFrame:
    """Rows with target per station and mask."""
    return (df.where(F.col(roles.target).isNotNull())
            .groupBy(F.col(roles.station).alias("station"), present_mask(variables).alias("mask"))
            .agg(F.count("*").alias("n_rows")))


def superset_counts(masks: DataFrame, n_bits: int) -> DataFrame:
    """For every mask that has one, the rows whose mask contains it.

    In each round a row is handed to all sub-masks within a few bits and the
    counts are added; after the last round every subset has its total. At most
    2^n_bits rows leave a round, however many rows the data has.
    """
    counts = masks
    for low in range(0, n_bits, BITS_PER_ROUND):
        width = min(BITS_PER_ROUND, n_bits - low)
        window = ((1 << width) - 1) << low
        part = F.shiftright(F.col("mask").bitwiseAND(F.lit(window).cast("bigint")), low)
        rest = F.col("mask").bitwiseAND(F.bitwise_not(F.lit(window).cast("bigint")))
        subs = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << width) - 1).cast("bigint")),
                        lambda s: s.bitwiseAND(part) == s)
        counts = (counts.select(rest.alias("rest"), "n_rows", F.explode(subs).alias("sub"))
                  .groupBy((F.col("rest") + F.shiftleft(F.col("sub"), low)).alias("mask"))
                  .agg(F.sum("n_rows").alias("n_rows")))
    return counts


def combination_counts(masks: DataFrame, variables: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """(k, mask, n_rows) of every combination of the given sizes, also empty ones."""
    p = len(variables)
    if p > MASK_BITS:
        raise ValueError(f"masks have {MASK_BITS} bits; {p} variables do not fit")
    wanted = sorted({k for k in sizes if 0 < k <= p})
    every = subsets(masks.sparkSession, p, wanted)
    if wanted and not _few_masks(p, wanted):
        # Few of all combinations are wanted: a row is handed to those of its mask.
        counts = subset_counts(masks.select("mask", "n_rows"), p, wanted)
    else:
        counts = superset_counts(masks.select("mask", "n_rows"), p)
    return (every.join(counts, "mask", "left")
            .select("k", "mask", F.coalesce("n_rows", F.lit(0)).alias("n_rows")))


def _grown(rows: DataFrame, p: int, allowed: Column) -> DataFrame:
    """Masks with one more bit, below the lowest they have, out of the allowed ones."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    lower = F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: (i < F.col("lowest")) & (allowed.bitwiseAND(bit(i)) != 0))
    keep = [c for c in rows.columns if c not in ("mask", "lowest")]
    return (rows.select(*keep, "mask", F.explode(lower).alias("i"))
            .select(*keep, (F.col("mask") + bit(F.col("i"))).alias("mask"), F.col("i").alias("lowest")))


def subsets(spark: SparkSession, p: int, sizes: Sequence[int]) -> DataFrame:
    """(k, mask) of every subset of the given sizes.

    Where they are a good part of all 2^p masks these are counted through; else each size is made
    from the one below and stored, so that no step is done again for the next.
    """
    if not sizes:
        return spark.range(0).select(F.lit(0).alias("k"), F.col("id").alias("mask"))
    if _few_masks(p, sizes):
        every = spark.range(1 << p).select(F.bit_count("id").alias("k"), F.col("id").alias("mask"))
        return every.where(F.col("k").isin([int(k) for k in sizes]))
    rows = spark.range(1).select(F.lit(0).cast("bigint").alias("mask"), F.lit(p).alias("lowest"))
    found = []
    for k in range(1, max(sizes) + 1):
        rows = store(_grown(rows, p, F.lit((1 << p) - 1).cast("bigint")), "subsets")
        if k in sizes:
            found.append(rows.select(F.lit(k).alias("k"), "mask"))
    return reduce(DataFrame.unionByName, found)


def _few_masks(p: int, sizes: Sequence[int]) -> bool:
    """Whether counting through all masks is less work than making the subsets of the sizes up to the largest."""
    return 1 << p <= max(4 * sum(comb(p, k) for k in range(max(sizes, default=0) + 1)), 1 << 16)


def subset_counts(masks: DataFrame, p: int, sizes: Sequence[int]) -> DataFrame:
    """For every subset of the given sizes that a mask contains, the rows of those masks."""
    rows = masks.groupBy(F.col("mask").alias("whole")).agg(F.sum("n_rows").alias("n_rows")).select(
        "whole", "n_rows", F.lit(0).cast("bigint").alias("mask"), F.lit(p).alias("lowest"))
    found = []
    for k in range(1, max(sizes, default=0) + 1):
        rows = store(_grown(rows, p, F.col("whole")), "subset-rows")
        if k in sizes:
            found.append(rows.select("mask", "n_rows"))
    return reduce(DataFrame.unionByName, found).groupBy("mask").agg(F.sum("n_rows").alias("n_rows"))


def _ranked(counts: DataFrame) -> DataFrame:
    order = Window.partitionBy("k").orderBy(F.col("n_rows").desc(), F.col("mask").desc())
    return counts.withColumn("rank", F.row_number().over(order))


def top_combinations(df: DataFrame, roles: Roles, variables: Sequence[str],
                     sizes: Sequence[int], n: int = 10) -> DataFrame:
    """The n combinations of each size that keep the most rows."""
    masks = station_masks(df, roles, variables)
    best = _ranked(combination_counts(masks, variables, sizes)).where(F.col("rank") <= n)
    return best.select("k", "rank", mask_names(F.col("mask"), variables).alias("combinacion"),
                       F.col("n_rows").alias("filas_restantes"))


def tradeoff(df: DataFrame, roles: Roles, variables: Sequence[str],
             sizes: Sequence[int]) -> DataFrame:
    """Best combination of each size, its rows, and the stations it leaves."""
    masks = cached(station_masks(df, roles, variables))
    best = cached(_ranked(combination_counts(masks, variables, sizes)).where(F.col("rank") == 1))
    winners = [(r["k"], r["mask"]) for r in best.select("k", "mask").collect()]
    if not winners:
        return best.select(F.col("k").alias("num_variables"),
                           F.lit("").alias("mejor_combinacion"),
                           F.col("n_rows").alias("filas_maximas"),
                           F.lit(0).cast("bigint").alias("estaciones_restantes"))
    fits = lambda m: F.col("mask").bitwiseAND(F.lit(m).cast("bigint")) == F.lit(m).cast("bigint")
    stations = (masks.where(F.col("station").isNotNull()).groupBy("station")
                .agg(*[F.max(fits(m)).alias(f"k{k}") for k, m in winners])
                .agg(*[F.coalesce(F.sum(F.col(f"k{k}").cast("bigint")), F.lit(0)).alias(f"k{k}")
                       for k, _ in winners]))
    left = stations.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("n_stations"))
        for k, _ in winners])).alias("r")).select("r.*")
    return best.join(left, "k").select(
        F.col("k").alias("num_variables"),
        mask_names(F.col("mask"), variables).alias("mejor_combinacion"),
        F.col("n_rows").alias("filas_maximas"), F.col("n_stations").alias("estaciones_restantes"))


def elbow(curve: DataFrame, x: str, y: str, sensitivity: float = 1.0) -> DataFrame:
    """Kneedle on a convex, decreasing curve of one row per size.

    Both axes are scaled to 0..1 and the distance d = (1 - y) - x is taken. A local
    maximum of d is a knee when d falls below (maximum - S * mean x step) before
    the next local maximum. The elbow is the first knee.
    """
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("x")
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(every),
                                             F.max(c).over(every) - F.min(c).over(every)), F.lit(0.0))
    d = (curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
         .withColumns({"x_unit": unit("x"), "y_unit": unit("y")})
         .withColumn("d", 1 - F.col("y_unit") - F.col("x_unit"))
         .withColumns({"before": F.lag("d").over(order), "after": F.lead("d").over(order),
                       "step": F.try_divide(F.lit(1.0), F.count("*").over(every) - 1)}))
    peak = (F.col("d") >= F.col("before")) & (F.col("d") >= F.col("after"))
    d = d.withColumn("is_peak", F.coalesce(peak, F.lit(False)))
    d = d.withColumns({
        "threshold": F.when(F.col("is_peak"), F.col("d") - sensitivity * F.col("step")),
        "peak_no": F.sum(F.col("is_peak").cast("int")).over(order)})
    # Least distance from a peak up to the next one.
    least = F.min(F.when(~F.col("is_peak"), F.col("d"))).over(Window.partitionBy("peak_no"))
    d = d.withColumn("is_knee", F.coalesce(F.col("is_peak") & (least < F.col("threshold")),
                                           F.lit(False)))
    first = F.min(F.when(F.col("is_knee"), F.col("x"))).over(every)
    return d.select(F.col("x").cast("bigint").alias(x), F.col("y").cast("bigint").alias(y),
                    "x_unit", "y_unit", F.col("d").alias("distance"), "is_peak", "threshold",
                    F.coalesce(F.col("x") == first, F.lit(False)).alias("is_elbow"))


def scored_combinations(df: DataFrame, roles: Roles, variables: Sequence[str],
                        sizes: Sequence[int], weight_rows: float = 0.5,
                        weight_corr: float = 0.5) -> DataFrame:
    """Combinations scored by rows kept and mean |correlation| with the log target."""
    strength = {r["variable"]: abs(r["r"]) for r in
                target_correlation(df, variables, roles.target).collect() if r["r"] is not None}
    counts = combination_counts(station_masks(df, roles, variables), variables, sizes)
    has = lambda i: F.col("mask").bitwiseAND(F.lit(_bit(variables, i)).cast("bigint")) != 0
    known = [(i, strength[v]) for i, v in enumerate(variables) if v in strength]
    if known:
        summed = total([F.when(has(i), F.lit(s)).otherwise(0.0) for i, s in known])
        number = total([F.when(has(i), 1).otherwise(0) for i, _ in known])
        mean = F.try_divide(summed, number)
    else:
        mean = F.lit(None).cast("double")
    table = cached(counts.withColumn("corr", mean))
    low_n, high_n, low_c, high_c = table.agg(F.min("n_rows"), F.max("n_rows"),
                                             F.min("corr"), F.max("corr")).first()
    rows_unit = min_max(F.col("n_rows"), low_n, high_n)
    corr_unit = min_max(F.col("corr"), low_c, high_c)
    return table.select(
        F.col("k").alias("num_variables_wq"),
        mask_names(F.col("mask"), variables).alias("combinacion_wq"),
        F.col("n_rows").alias("filas_restantes"), F.col("corr").alias("correlacion_promedio_wq"),
        rows_unit.alias("filas_norm"), corr_unit.alias("corr_norm"),
        (weight_rows * rows_unit + weight_corr * corr_unit).alias("score_final"))


def best_scores(scored: DataFrame, n: int = 15) -> DataFrame:
    """The n best by score; ties by name."""
    return scored.orderBy(F.col("score_final").desc_nulls_last(), "combinacion_wq").limit(n)
