"""Exact interpolated quantiles per group.

``bracketed`` (the usual plan) reads the rows twice. Mergeable sketches of each group and variable
give bounds between which a wanted rank must lie; the second scan keeps values between the
bounds and only counts all others, in one hash aggregate. What is left, a few percent of the
values, is ranked as below. A rank that falls among values that were only counted shows: its
group is then ranked in full, so the answer never rests on the sketch.

``ranked`` counts the distinct values of each group and variable, spreads them over the tasks by range
of (group, variable, value) and stores them once. Sizes of the pieces tell which pieces hold the
wanted ranks; only those are read again and summed up in order. A group of any size is
split by its values, nothing is approximate and nothing can miss.

``direct`` uses the built-in ``percentile`` instead, whose state holds every distinct value of
a group in one task: for callers who know that their groups are small.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwater.plans.keep import cached, settle, store

STRATEGIES = ("bracketed", "ranked", "direct")
log = logging.getLogger(__name__)

# The sketch places a value within 1/ACCURACY of its share of the group.
ACCURACY = 1000
# Bounds lie this far on either side of a wanted share, in groups of more values than the first number:
# the error of the sketch and two whole ranks. Smaller groups are kept whole.
MARGINS = ((2000, 0.002), (100, 0.021))
# So many counted values are put in order without pieces: even if all were of one group, a task sorts them.
FEW = 2_000_000


def percentile_array(col: Column, probs: Sequence[float]) -> Column:
    return F.percentile(col, F.array(*[F.lit(float(p)) for p in probs]))


def exact_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                    probs: dict[str, float], strategy: str = "bracketed") -> DataFrame:
    """One row per group and variable: keys, ``variable``, and one column per quantile.

    Groups in which a variable has no value give null quantiles.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    plan = {"bracketed": _bracketed, "ranked": _ranked, "direct": _direct}[strategy]
    return plan(df, by, columns, probs)


def _direct(df: DataFrame, by: Sequence[str], columns: Sequence[str],
            probs: dict[str, float]) -> DataFrame:
    wide = df.groupBy(*by).agg(*[
        percentile_array(F.col(c), list(probs.values())).alias(f"q{i}")
        for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"q{i}").alias("q"))
                     for i, c in enumerate(columns)])
    return (wide.select(*by, F.explode(rows).alias("r"))
            .select(*by, "r.variable", *[F.col("r.q")[j].alias(name)
                                         for j, name in enumerate(probs)]))


def _ranked(df: DataFrame, by: Sequence[str], columns: Sequence[str],
            probs: dict[str, float]) -> DataFrame:
    counts = _long(df, by, columns, [F.lit(None)] * len(columns)).groupBy(*by, "_i", "_value").agg(
        F.sum("_one").alias("_n"), F.lit(False).alias("_lump"))
    return _picked(counts, by, columns, probs).drop("_missed")


def _bracketed(df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: dict[str, float],
               accuracy: int = ACCURACY, margins: Sequence[tuple[int, float]] = MARGINS) -> DataFrame:
    bounds = _bounds(df, by, columns, sorted(set(probs.values())), accuracy, margins)
    bounded = df
    if by:
        # A row for each group, broadcast only if it is small.
        names = {b: f"_of_{b}" for b in by}
        same = _same_keys(by, names)
        bounded = df.select(*dict.fromkeys([*by, *columns])).join(settle(bounds.withColumnsRenamed(names)), same)
        limits = [F.col(f"_b{i}") for i in range(len(columns))]
    else:
        row = bounds.first()
        limits = [F.lit(None) if row[f"_b{i}"] is None else F.array(*[F.lit(x) for x in row[f"_b{i}"]])
                  for i in range(len(columns))]
    # Values outside all bounds share a key with the others of their gap.
    counts = (_long(bounded, by, columns, limits, len(set(probs.values())))
              .groupBy(*by, "_i", "_gap", F.when(F.col("_gap").isNull(), F.col("_value")).alias("_kept"))
              .agg(F.sum("_one").alias("_n"), F.min("_value").alias("_value"), F.max("_value").alias("_most"))
              .select(*by, "_i", "_value", "_n", F.coalesce(F.col("_value") < F.col("_most"), F.lit(False)).alias("_lump")))
    counts = cached(counts)
    plan = _in_order if counts.count() <= FEW else _picked
    found = cached(plan(counts, by, columns, probs))
    missed = found.where("_missed").select(*by, "variable")
    again = sorted(found.agg(F.collect_set(F.when(F.col("_missed"), F.col("variable")))).first()[0])  # at most the columns
    if not again:
        return found.drop("_missed")
    log.warning("bounds of %s missed a rank; ranked in full", ", ".join(again))
    if by:
        names = {b: f"_of_{b}" for b in by}
        groups = missed.select(*by).distinct().withColumnsRenamed(names)
        df = df.join(groups, _same_keys(by, names), "left_semi")
    whole = _ranked(df, by, again, probs)
    names = {k: f"_of_{k}" for k in [*by, "variable"]}
    # A whole table has one group, whose missed variables are known by name.
    wanted = (whole.join(missed.withColumnsRenamed(names), _same_keys([*by, "variable"], names), "left_semi")
              if by else whole)
    return found.where(~F.col("_missed")).drop("_missed").unionByName(wanted)


def _same_keys(keys: Sequence[str], names: dict[str, str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    return same


def _bounds(df: DataFrame, by: Sequence[str], columns: Sequence[str], shares: Sequence[float],
            accuracy: int, margins: Sequence[tuple[int, float]]) -> DataFrame:
    """For each group the lower bounds of all shares, then the upper ones, as array ``_b<i>``; null keeps all."""
    asked = [min(max(p + side * margin, 0.0), 1.0) for _, margin in margins for side in (-1, 1) for p in shares]
    sketches = df.groupBy(*by).agg(*[e for i, c in enumerate(columns) for e in (
        F.count(F.col(c).cast("double")).alias(f"_n{i}"),
        F.percentile_approx(F.col(c).cast("double"), asked, accuracy).alias(f"_a{i}"))])
    k = len(shares)

    def half(i: int, at: int) -> Column:
        return F.sort_array(F.slice(F.col(f"_a{i}"), at * k + 1, k))

    def chosen(i: int) -> Column:
        out = F.lit(None)
        for m, (size, _) in reversed(list(enumerate(margins))):
            out = F.when(F.col(f"_n{i}") > size, F.concat(half(i, 2 * m), half(i, 2 * m + 1))).otherwise(out)
        return out.cast("array<double>").alias(f"_b{i}")

    return sketches.select(*by, *[chosen(i) for i in range(len(columns))])


def _long(df: DataFrame, by: Sequence[str], columns: Sequence[str], limits: Sequence[Column],
          shares: int = 0) -> DataFrame:
    """A row for each cell: keys, ``_i``, ``_value``, ``_one`` (zero where empty), and ``_gap``, the number of
    bounds below a value that none of them holds (null for values to keep)."""
    cells = [F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_value"), limits[i].cast("array<double>").alias("_bounds"))
             for i, c in enumerate(columns)]
    cells = df.select(*by, F.explode(F.array(*cells)).alias("_cell")).select(*by, "_cell.*")
    # Worked out behind the explode, so its code is there once and not for each column.
    value, bounds = F.col("_value"), F.col("_bounds")
    outside, below = bounds.isNotNull() & value.isNotNull(), F.lit(0)
    for j in range(shares):
        low, high = bounds[j], bounds[shares + j]
        outside = outside & ~value.between(low, high)
        below = below + F.when(value > high, 1).otherwise(0)
    gap = F.when(outside, below) if shares else F.lit(None).cast("int")
    long = cells.select(*by, "_i", "_value", gap.alias("_gap"), value.isNotNull().cast("int").alias("_one"))
    if by:
        return long
    # Without keys there is one group, even if the table is empty.
    seeds = F.array(*[F.lit(i) for i in range(len(columns))])
    return long.unionByName(df.sparkSession.range(1).select(
        F.explode(seeds).alias("_i"), F.lit(None).cast("double").alias("_value"),
        F.lit(None).cast("int").alias("_gap"), F.lit(0).alias("_one")))


def _picked(counts: DataFrame, by: Sequence[str], columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles from counted values (a null value stands for the group itself and counts nothing).

    ``_missed`` tells that a wanted rank lies among values that were counted together.
    """
    spark = counts.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = store(counts.repartitionByRange(number, *by, "_i", "_value")
                   .withColumn("_piece", F.spark_partition_id()), "ranked-values")

    group = Window.partitionBy(*by, "_i")
    sizes = pieces.groupBy(*by, "_i", "_piece").agg(F.sum("_n").alias("_size"))
    sizes = sizes.withColumns({
        "_total": F.sum("_size").over(group),
        "_before": F.sum("_size").over(group.orderBy("_piece").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("_size")})
    places = _places(probs)
    wanted = F.col("_total") == 0
    for at in places:
        wanted = wanted | ((F.col("_before") <= F.ceil(at)) & (F.floor(at) < F.col("_before") + F.col("_size")))
    keys = [*by, "_i", "_piece"]
    needed = sizes.where(wanted).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    found = pieces.join(needed, same).drop(*[f"_of_{k}" for k in keys])
    found = found.withColumn("_stop", F.col("_before") + _upto(keys)).withColumn("_start", F.col("_stop") - F.col("_n"))
    return _at_ranks(found, by, columns, probs)


def _in_order(counts: DataFrame, by: Sequence[str], columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """The same from few counted values: each group is put in order as a whole."""
    keys = [*by, "_i"]
    found = counts.withColumns({"_stop": _upto(keys), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
    return _at_ranks(found.withColumn("_start", F.col("_stop") - F.col("_n")), by, columns, probs)


def _upto(keys: Sequence[str]) -> Column:
    return F.sum("_n").over(Window.partitionBy(*keys).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))


def _places(probs: dict[str, float]) -> list[Column]:
    return [(F.col("_total") - 1) * F.lit(float(p)) for p in probs.values()]


def _at_ranks(found: DataFrame, by: Sequence[str], columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles from counted values with the ranks at which each starts and stops."""
    places = _places(probs)

    def here(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_stop"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when(here(rank), F.col("_value")))

    hit = F.lit(False)
    for at in places:
        hit = hit | here(F.floor(at)) | here(F.ceil(at))

    picked = found.groupBy(*by, "_i").agg(*[e for j, at in enumerate(places) for e in (
        value_at(F.floor(at)).alias(f"_low{j}"), value_at(F.ceil(at)).alias(f"_high{j}"),
        F.max(at - F.floor(at)).alias(f"_part{j}"))], F.coalesce(F.max(F.col("_lump") & hit), F.lit(False)).alias("_missed"))
    variable = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_i") + 1).alias("variable")
    return picked.select(*by, variable, *[
        (F.col(f"_low{j}") + (F.col(f"_high{j}") - F.col(f"_low{j}")) * F.col(f"_part{j}")).alias(name)
        for j, name in enumerate(probs)], "_missed")
