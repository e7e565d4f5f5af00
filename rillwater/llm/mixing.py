"""Mixing documents to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic. The weights of the cells are raked: scaled
to the target share of each source, then of each language, then of each topic, again and again,
never above what a cell has, until all marginals are met or a limit holds. Each document is then
kept with the probability of its cell, by a hash of its id, so the choice is the same in every run.

Every category has its own marginal, however small. Up to ``DRIVER_CELLS`` cells are raked in numpy
on the driver, larger tables by the same steps in Spark: a sum by category and a join for each kind
and round. Pooling is for callers who ask for it (``least_share``): categories with less than that
share of the tokens become ``(other)``, but never one that ``targets`` names. A target for ``(other)`` itself
pools all categories of its kind that have no target; without it those have the target 0.

Defined results: a null category is a category of its own, ``(none)``; null and empty texts have no
tokens and are kept with the probability of their cell (1 where a cell has no tokens). Rows that
repeat, and ids that tie, are kept or left together. An empty table gives no rows. Other columns
take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm.tables import col, written
from rillwater.plans.keep import settle

NONE, POOLED = "(none)", "(other)"
KINDS = ("source", "lang", "topic")
DRIVER_CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic by fixed marks of a text; the first that holds."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    legal = [F.contains(low, F.lit(w)) for w in ("license", "licence", "all rights reserved", "copyright")]
    # The plain searches spare most texts the patterns.
    address = F.contains(text, F.lit("@")) & text.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.")
    number = F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9][0-9 ().-]{8}")
    return (F.when(legal[0] | legal[1] | legal[2] | legal[3], "legal")
            .when(address | number, "contact")
            .when(text.rlike(r"[!*$%&#]{2}"), "noise")
            .when(F.length(text) < 600, "note")
            .when(F.length(text) < 6000, "article").otherwise("long form"))


def tokens_of(text: Column) -> Column:
    """Number of words, as a measure of tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def rake(mass: np.ndarray, targets: list[np.ndarray], total: float, rounds: int = 200, precision: float = 1e-9) -> np.ndarray:
    """Weights of the cells, none above its mass, with marginal sums as near to ``total`` times the targets as the mass allows."""
    kept = mass * min(1.0, total / max(mass.sum(), 1e-300))
    for _ in range(rounds):
        before = kept.copy()
        for axis, target in enumerate(targets):
            others = tuple(a for a in range(mass.ndim) if a != axis)
            sums = kept.sum(axis=others)
            factor = np.where(sums > 0, target * total / np.where(sums > 0, sums, 1), 1.0)
            kept = np.minimum(kept * factor.reshape([-1 if a == axis else 1 for a in range(mass.ndim)]), mass)
        if np.abs(kept - before).max() <= precision * max(total, 1):
            break
    return kept


def tempered(shares: np.ndarray, power: float) -> np.ndarray:
    """Shares drawn towards each other: small categories gain, large ones lose."""
    raised = np.where(shares > 0, shares, 0) ** power * (shares > 0)
    return raised / raised.sum() if raised.sum() else raised


def _pooled(sums: DataFrame, names: list[str], targets: dict[str, dict[str, float]], total: int, least_share: float) -> DataFrame:
    """``sums`` with the group of each category: itself, or ``(other)`` where it is pooled."""
    for n in names:
        group = F.col(n)
        given = targets.get(n, {})
        if least_share > 0 or POOLED in given:
            shares = written(sums.groupBy(n).agg(F.sum("tokens").alias("tokens")), "category-sums")
            named = sums.sparkSession.createDataFrame([(a,) for a in given], "named string")
            shares = shares.join(named, F.col(n) == F.col("named"), "left")
            large = F.lit(False) if POOLED in given else F.col("tokens") >= max(1.0, least_share * total)
            own = shares.where(large | F.col("named").isNotNull()).select(F.col(n).alias("own"))
            sums, group = sums.join(own, F.col(n) == F.col("own"), "left"), F.coalesce("own", F.lit(POOLED))
        sums = sums.withColumn(f"{n}_group", group).drop("own")
    return sums


def _shares(values: np.ndarray, names: list[str], given: dict[str, float] | None, power: float) -> np.ndarray:
    """Target shares of the categories of a kind, from their tokens or as given."""
    if given is None:
        return tempered(values / max(values.sum(), 1), power)
    wanted = np.array([given.get(a, 0.0) for a in names])
    return wanted / max(wanted.sum(), 1e-300)


def _raked_on_driver(cells: DataFrame, groups: list[str], targets: dict[str, dict[str, float]], total: float, power: float,
                     rounds: int, precision: float) -> DataFrame:
    rows = cells.select(*groups, "tokens").toArrow()
    mass = rows.column("tokens").to_numpy().astype(np.float64)
    codes, wanted = [], []
    for g in groups:
        column = rows.column(g).combine_chunks().dictionary_encode()
        codes.append(column.indices.to_numpy())
        names = column.dictionary.to_pylist()
        wanted.append(_shares(np.bincount(codes[-1], mass, len(names)), names, targets.get(g.removesuffix("_group")), power))
    kept = mass * min(1.0, total / max(mass.sum(), 1e-300))
    for _ in range(rounds if len(mass) else 0):
        before = kept.copy()
        for code, target in zip(codes, wanted):
            sums = np.bincount(code, kept, len(target))
            factor = np.where(sums > 0, target * total / np.where(sums > 0, sums, 1), 1.0)
            kept = np.minimum(kept * factor[code], mass)
        if np.abs(kept - before).max() <= precision * max(total, 1):
            break
    raked = pa.table([*[rows.column(g) for g in groups], rows.column("tokens"), pa.array(kept)], names=[*groups, "tokens", "kept"])
    schema = cells.select(*groups, "tokens").withColumn("kept", F.lit(0.0)).schema
    return cells.sparkSession.createDataFrame(raked, schema)


def _raked_in_spark(cells: DataFrame, groups: list[str], targets: dict[str, dict[str, float]], total: float, power: float,
                    rounds: int, precision: float) -> DataFrame:
    spark, mass, wanted = cells.sparkSession, cells.agg(F.sum("tokens")).first()[0] or 0, []
    for g in groups:
        given = targets.get(g.removesuffix("_group"))
        shares = cells.groupBy(g).agg(F.sum("tokens").alias("tokens"))
        if given is None:
            shares = shares.select(g, F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(max(mass, 1)), F.lit(power))).otherwise(0.0).alias("target"))
        else:
            named = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{g} string, target double")
            shares = shares.join(named, g, "left").select(g, F.coalesce("target", F.lit(0.0)).alias("target"))
        shares = written(shares, "marginals")
        whole = shares.agg(F.sum("target")).first()[0] or 1e-300
        wanted.append(shares.withColumn("target", F.col("target") / whole))
    state = written(cells.withColumn("kept", F.col("tokens") * float(min(1.0, total / max(mass, 1e-300)))), "raked")
    for _ in range(rounds):
        now = state.withColumn("before", F.col("kept"))
        for g, target in zip(groups, wanted):
            sums = now.groupBy(g).agg(F.sum("kept").alias("sum")).join(target, g)
            factor = F.when(F.col("sum") > 0, F.col("target") * total / F.col("sum")).otherwise(1.0)
            now = now.join(sums.select(g, factor.alias("factor")), g)
            now = written(now.withColumn("kept", F.least(F.col("kept") * F.col("factor"), F.col("tokens").cast("double"))).drop("factor"), "raked")
        moved = now.agg(F.max(F.abs(F.col("kept") - F.col("before")))).first()[0] or 0.0
        state = now.drop("before")
        if moved <= precision * max(total, 1):
            break
    return state


def cell_probabilities(docs: DataFrame, kinds: dict[str, Column], tokens: Column, targets: dict[str, dict[str, float]] | None = None,
                       keep_share: float = 0.75, power: float = 0.7, least_share: float = 0.0, rounds: int = 200,
                       precision: float = 1e-9) -> DataFrame:
    """A row (categories..., their groups..., probability) for each combination of categories in the documents."""
    names, targets = list(kinds), targets or {}
    groups = [f"{n}_group" for n in names]
    given = docs.select(*[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in kinds.items()], tokens.alias("tokens"))
    # The texts are read once for this; all else is made from the sums by category.
    sums = written(given.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "token-sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    grouped = written(_pooled(sums, names, targets, total, least_share), "token-groups")
    cells = written(grouped.groupBy(*groups).agg(F.sum("tokens").cast("bigint").alias("tokens")), "cells")
    rake_cells = _raked_on_driver if cells.count() <= DRIVER_CELLS else _raked_in_spark
    raked = rake_cells(cells, groups, targets, keep_share * total, power, rounds, precision)
    probability = F.when(F.col("tokens") > 0, F.col("kept") / F.col("tokens")).otherwise(1.0)
    return written(grouped.drop("tokens").join(raked.select(*groups, probability.alias("probability")), groups), "probabilities")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        topic: Column | None = None, seed: int = 7, **settings) -> DataFrame:
    """``row`` (all columns of the document), source_group, lang_group, topic, tokens, probability and kept of every document."""
    topic = topic_of(col(text_col)) if topic is None else topic
    tokens = tokens_of(col(text_col))
    kinds = dict(zip(KINDS, (col(source_col), col(lang_col), topic)))
    cells = cell_probabilities(docs, kinds, tokens, **settings)
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), F.xxhash64(col(id_col), F.lit(seed)).alias("draw"), tokens.alias("tokens"),
                       *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in kinds.items()])
    joined = rows.join(settle(cells), list(KINDS))  # sent to all tasks only where it is small
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    return joined.select("row", "source_group", "lang_group", F.col("topic_group").alias("topic"), "tokens", "probability",
                         (share < F.col("probability")).alias("kept"))
