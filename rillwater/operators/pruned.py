"""The best combinations out of many variables, without making all of them.

A combination never keeps more rows than a part of it. So once n combinations of a size are known, a part that
keeps fewer rows than the worst of them cannot lead to a better one, and all that would grow from it is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, islice
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.operators.combos import MASK_BITS, _grown, mask_names, station_masks
from rillwater.plans.keep import cached, store

BEAM = 64


class PrunedSearch(NamedTuple):
    """The best of every size, and by size the parts that were counted and those that were followed."""
    best: DataFrame
    effort: DataFrame


def _mask(bits: Sequence[int]) -> int:
    return sum(1 << b for b in bits)


def _literal(masks: Sequence[int]) -> Column:
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")


def row_cuts(masks: DataFrame, p: int, sizes: Sequence[int], n: int, beam: int = BEAM) -> dict[int, int]:
    """For each size a number of rows that its n-th best combination reaches, at least 1.

    The widest parts of each size are grown by one variable and counted: at most ``beam`` times p at once. Any n of
    them bound the n-th best from below; a better bound only saves work.
    """
    beam = max(beam, n)
    cuts, parts = {}, [0]
    for k in range(1, max(sizes, default=0) + 1):
        grown = sorted({m | 1 << i for m in parts for i in range(p) if not m >> i & 1}, reverse=True)
        inside = F.filter(_literal(grown), lambda m: m.bitwiseAND(F.col("mask")) == m)
        counts = (masks.select("n_rows", F.explode(inside).alias("part")).groupBy("part")
                  .agg(F.sum("n_rows").alias("n_rows")).orderBy(F.col("n_rows").desc(), F.col("part").desc()).limit(beam).collect())
        cuts[k] = counts[n - 1]["n_rows"] if len(counts) >= n else 1
        parts = [r["part"] for r in counts] or grown[:1]
    return {k: cuts[k] for k in sizes}


def _reaches(k: int, cuts: dict[int, int], rest: Column) -> list[tuple[str, Column]]:
    """For each wanted size from k on, the rows of a part of size k that have enough variables left for it."""
    return [(f"r{j}", F.sum(F.when(F.bit_count(rest) >= j - k, F.col("n_rows")))) for j in sorted(cuts) if j >= k]


def _with_useful(masks: DataFrame, p: int, least: int) -> DataFrame:
    """Masks without the variables that fewer rows have than the least cut."""
    one = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0
    have = masks.agg(*[F.sum(F.when(one(i), F.col("n_rows"))).alias(str(i)) for i in range(p)]).first()
    useful = _mask([i for i in range(p) if (have[i] or 0) >= least])
    return (masks.groupBy(F.col("mask").bitwiseAND(F.lit(useful).cast("bigint")).alias("mask"))
            .agg(F.sum("n_rows").alias("n_rows")))


def pruned_counts(masks: DataFrame, p: int, cuts: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """(k, mask, n_rows) of all combinations that reach the cut of their size, and (k, counted, followed).

    Combinations grow from the highest variable down, each from one part only. A row stays with a part as the bits
    below the part's lowest, and rows that are equal in them are added up, so they become fewer with every level. A
    part is followed if, for some wanted size, enough rows hold it together with as many more variables as it lacks;
    below it only variables stay that reach a cut beside the same higher ones.
    """
    empty = masks.sparkSession.createDataFrame([], "k int, mask bigint, n_rows bigint")
    found, effort = [empty], [masks.sparkSession.createDataFrame([], "k int, counted bigint, followed bigint")]
    rows = (masks.groupBy(F.col("mask").alias("whole")).agg(F.sum("n_rows").cast("bigint").alias("n_rows"))
            .select("whole", "n_rows", F.lit(0).cast("bigint").alias("mask"), F.lit(p).alias("lowest")))
    low = F.col("mask").bitwiseAND(-F.col("mask"))
    for k in range(1, max(cuts, default=0) + 1):
        below = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("lowest")) - 1
        rows = (_grown(rows, p, F.col("whole")).withColumn("whole", F.col("whole").bitwiseAND(below))
                .groupBy("mask", "lowest", "whole").agg(F.sum("n_rows").alias("n_rows")))
        rows = store(rows, "pruned-rows")
        reach = _reaches(k, cuts, F.col("whole"))
        parts = store(rows.groupBy("mask").agg(F.sum("n_rows").alias("n_rows"), *[c.alias(name) for name, c in reach]), "pruned-parts")
        good = reduce(Column.__or__, [F.coalesce(F.col(f"r{j}"), F.lit(0)) >= cuts[j] for j in cuts if j >= k])
        good_later = [F.coalesce(F.col(f"r{j}"), F.lit(0)) >= cuts[j] for j in cuts if j > k]
        if k in cuts:
            found.append(parts.where(F.col("n_rows") >= cuts[k]).select(F.lit(k).alias("k"), "mask", "n_rows"))
        effort.append(parts.agg(F.lit(k).alias("k"), F.count("*").alias("counted"), F.count(F.when(good, 1)).alias("followed")))
        if good_later:
            least = min(c for j, c in cuts.items() if j > k)
            parts = parts.withColumn("above", F.col("mask") - low)
            beside = parts.where(F.col("n_rows") >= least).groupBy("above").agg(F.bit_or(low).alias("beside"))
            followed = parts.where(reduce(Column.__or__, good_later)).join(beside, "above").select("mask", "beside")
            rows = rows.join(followed, "mask").withColumn("whole", F.col("whole").bitwiseAND(F.col("beside"))).drop("beside")
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, effort)


def _without_rows(spark: SparkSession, found: DataFrame, p: int, sizes: Sequence[int], n: int) -> DataFrame:
    """Combinations that no row has, for sizes with fewer than n others: the first in order that were not found."""
    first = [(k, _mask(bits)) for k in sizes for bits in islice(combinations(range(p - 1, -1, -1), k), 2 * n)]
    every = spark.createDataFrame(first, "k int, mask bigint")
    return every.join(found, ["k", "mask"], "left_anti").withColumn("n_rows", F.lit(0).cast("bigint"))


def pruned_combinations(df: DataFrame, roles: Roles, variables: Sequence[str], sizes: Sequence[int], n: int = 10,
                        beam: int = BEAM) -> PrunedSearch:
    """The same rows as ``combos.top_combinations``, also for variables whose combinations cannot all be made.

    One scan counts the masks; all else works on these. The effort says how many parts of each size some row has and
    were counted, and how many reached a cut. It grows with the combinations that keep about as many rows as the
    n-th best, ties included: where nearly all combinations tie, nearly all are made.
    """
    p, spark = len(variables), df.sparkSession
    if p > MASK_BITS:
        raise ValueError(f"masks have {MASK_BITS} bits; {p} variables do not fit")
    if n < 1:
        raise ValueError("n must be at least 1")
    wanted = sorted({k for k in sizes if 0 < k <= p})
    masks = cached(station_masks(df, roles, variables).groupBy("mask").agg(F.sum("n_rows").alias("n_rows")))
    cuts = row_cuts(masks, p, wanted, n, beam)
    found, effort = pruned_counts(_with_useful(masks, p, min(cuts.values(), default=1)), p, cuts)
    # Enough of a size were found, or all that have rows: then the others follow in order.
    order = Window.partitionBy("k").orderBy(F.col("n_rows").desc(), F.col("mask").desc())
    ranked = (found.unionByName(_without_rows(spark, found, p, wanted, n))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n))
    best = ranked.select("k", "rank", mask_names(F.col("mask"), variables).alias("combinacion"),
                         F.col("n_rows").alias("filas_restantes"))
    return PrunedSearch(best, effort)
