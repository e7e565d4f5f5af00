"""Monitoring-shaped views over the given tables, in Spark and in SQL.

Each view exists twice: as a DataFrame and as a common table expression with the
same expressions. The given tables have no nulls, so gaps are planted by key
arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.functions.scores import fit_sums, score_columns

VARIABLES = ("v1", "v2", "v3", "v4", "v5", "v6")
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
ROLES = Roles(target="target", features=VARIABLES, sample_key=KEY)
EVENT_ROLES = Roles(station="user_id", basin="event_type", date="ts", target="value",
                    features=(), sample_key=("event_id",))

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
GAUGES = tuple(f"g{i}" for i in range(1, 6))
THERMOMETERS = tuple(f"t{i}" for i in range(1, 6))
BASIN_PARAMETERS = ("basin_area_a", "drainage_density", "mean_slope")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: order lines at supplier stations in nation basins."""
    lines = table(spark, sf_dir, "lineitem")
    rows = (lines
            .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"),
                  F.col("l_suppkey") == F.col("s_suppkey"))
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")))
    key = F.col("l_suppkey").cast("string")
    unless = lambda hole, value: F.when(~hole, F.col(value) if isinstance(value, str) else value)
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    text = F.col("l_quantity").cast("bigint").cast("string")
    raw = (F.when(part % 10 == 0, "N/D").when(part % 10 == 1, "s/d").when(part % 10 == 2, "-")
           .when(part % 10 == 3, " ").when(part % 10 == 4, "5d").otherwise(text))
    return rows.select(
        *KEY, "n_nationkey", "n_regionkey",
        F.when(line % 2 == 0, F.concat(F.lit(" s"), key, F.lit(" ")))
        .otherwise(F.concat(F.lit("S"), key)).alias("station_raw"),
        F.concat(F.lit("S"), key).alias("station_code"),
        F.col("n_name").alias("basin"), F.col("l_shipdate").alias("date"),
        (F.datediff("l_shipdate", F.lit("1899-12-30").cast("date"))
         + (line % 4) * F.lit(0.25)).alias("date_serial"),
        unless(part % 11 == 0, "l_extendedprice").alias("target"),
        unless(order % 5 == 0, "l_quantity").alias("v1"),
        unless(part % 3 == 0, "l_discount").alias("v2"),
        unless((order + line) % 4 == 0, "l_tax").alias("v3"),
        unless(F.col("l_suppkey") % 7 == 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("v4"),
        unless(part % 13 < 6, line.cast("double")).alias("v5"),
        unless(order % 17 < 15, F.col("l_discount") * F.col("l_quantity")).alias("v6"),
        raw.alias("raw_v1"), F.lit(None).cast("string").alias("empty"))


WQ = """wq AS (
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, n_nationkey, n_regionkey,
  CASE WHEN l_linenumber % 2 = 0 THEN ' s' || l_suppkey || ' ' ELSE 'S' || l_suppkey END AS station_raw,
  'S' || l_suppkey AS station_code, n_name AS basin, l_shipdate AS date,
  date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) + (l_linenumber % 4) * CAST(0.25 AS DOUBLE) AS date_serial,
  CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice END AS target,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS v1,
  CASE WHEN l_partkey % 3 <> 0 THEN l_discount END AS v2,
  CASE WHEN (l_orderkey + l_linenumber) % 4 <> 0 THEN l_tax END AS v3,
  CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice / l_quantity END AS v4,
  CASE WHEN l_partkey % 13 >= 6 THEN CAST(l_linenumber AS DOUBLE) END AS v5,
  CASE WHEN l_orderkey % 17 >= 15 THEN l_discount * l_quantity END AS v6,
  CASE l_partkey % 10 WHEN 0 THEN 'N/D' WHEN 1 THEN 's/d' WHEN 2 THEN '-' WHEN 3 THEN ' '
   WHEN 4 THEN '5d' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS raw_v1
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rain, one column per gauge (order priority)."""
    return (table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("date"))
            .agg(*[F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice") / 10000)).alias(g)
                   for g, p in zip(GAUGES, PRIORITIES)]))


RAIN = "rain AS (SELECT o_orderdate AS date, " + ", ".join(
    f"avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice / 10000 END) AS {g}"
    for g, p in zip(GAUGES, PRIORITIES)) + " FROM orders GROUP BY o_orderdate)"


def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily temperature, one column per market segment, and hours of sun."""
    return (table(spark, sf_dir, "orders")
            .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("o_orderdate").alias("date"))
            .agg(*[F.avg(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal") / 100)).alias(t)
                   for t, s in zip(THERMOMETERS, SEGMENTS)],
                 (F.count("*") % 13).cast("double").alias("sun")))


TEMP = "temp AS (SELECT o_orderdate AS date, " + ", ".join(
    f"avg(CASE WHEN c_mktsegment = '{s}' THEN c_acctbal / 100 END) AS {t}"
    for t, s in zip(THERMOMETERS, SEGMENTS)) + (
    ", CAST(count(*) % 13 AS DOUBLE) AS sun FROM orders JOIN customer ON o_custkey = c_custkey"
    " GROUP BY o_orderdate)")


def basin_long(spark: SparkSession, sf_dir: str, holes: bool = True) -> DataFrame:
    """Basin parameters in long form; with ``holes`` stations ending in 3 have none, for the
    checks of unmatched and inherited rows.

    Every parameter is stated twice; the second statement is the one that counts.
    """
    lines = table(spark, sf_dir, "lineitem")
    wide = ((lines.where(F.col("l_suppkey") % 10 != 3) if holes else lines)
            .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station_code"),
                     F.col("n_name").alias("basin"))
            .agg(F.avg("p_size").alias("basin_area_a"),
                 (F.count("*") / F.lit(100.0)).alias("drainage_density"),
                 F.avg(F.col("p_retailprice") / 100).alias("mean_slope")))
    stated = [F.struct(F.lit(n).alias("Parameter"),
                       (F.lit(-1.0) if first else F.col(n)).alias("Value"),
                       F.lit(1 if first else 2).alias("line"))
              for first in (True, False) for n in BASIN_PARAMETERS]
    return wide.select("station_code", "basin", F.explode(F.array(*stated)).alias("p")) \
        .select("station_code", "basin", "p.*")


BASIN = """basin_wide AS (
 SELECT 'S' || l_suppkey AS station_code, n_name AS basin, avg(p_size) AS basin_area_a,
  count(*) / CAST(100 AS DOUBLE) AS drainage_density, avg(p_retailprice / 100) AS mean_slope
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey WHERE l_suppkey % 10 <> 3 GROUP BY 1, 2)"""

BASIN_ALL = BASIN.replace(" WHERE l_suppkey % 10 <> 3", "")


def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations ending in 3 copy their neighbour; plus a child that exists (S5)
    and a parent that does not (X9)."""
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    text = lambda c: F.concat(F.lit("S"), c.cast("string"))
    pairs = keys.where(F.col("s_suppkey") % 10 == 3).select(
        text(F.col("s_suppkey")).alias("child"), text(F.col("s_suppkey") - 1).alias("parent"))
    odd = keys.where(F.col("s_suppkey") < 2).select(
        F.when(F.col("s_suppkey") == 0, "S5").otherwise("X8").alias("child"),
        F.when(F.col("s_suppkey") == 0, "S1").otherwise("X9").alias("parent"))
    return pairs.unionByName(odd)


INHERITED = """inherited AS (
 SELECT 'S' || s_suppkey AS child, 'S' || (s_suppkey - 1) AS parent FROM supplier WHERE s_suppkey % 10 = 3
 UNION ALL SELECT 'S5', 'S1' UNION ALL SELECT 'X8', 'X9'),
basins AS (
 SELECT * FROM basin_wide UNION ALL
 SELECT i.child, b.basin, b.basin_area_a, b.drainage_density, b.mean_slope
 FROM inherited i JOIN basin_wide b ON b.station_code = i.parent
 WHERE i.child NOT IN (SELECT station_code FROM basin_wide))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed predictions: observed log value plus a shift set by the key."""
    y = F.log1p("target")
    return (wq(spark, sf_dir).where(F.col("target").isNotNull())
            .withColumns({"y": y, "p": y + (F.col("l_partkey") % 7 - 2) * F.lit(0.05)}))


PRED = """pred AS (
 SELECT *, ln(1 + target) AS y, ln(1 + target) + (l_partkey % 7 - 2) * CAST(0.05 AS DOUBLE) AS p
 FROM wq WHERE target IS NOT NULL)"""

MODELS = ("Linear Regression", "Random Forest", "Ridge")


def fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold results by experiment (region), cluster, model and fold, scored from the
    fixed predictions."""
    line = F.col("l_linenumber") % 3
    model = (F.when(line == 0, MODELS[0]).when(line == 1, MODELS[1]).otherwise(MODELS[2]))
    keys = {"model": model,
            "base_experiment_id": F.concat(F.lit("EXP_"), F.col("n_regionkey").cast("string")),
            "cluster_id": F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") % 4),
            "fold": (F.col("l_orderkey") % 5 + 1).cast("int")}
    sums = (predictions(spark, sf_dir).groupBy(*[c.alias(n) for n, c in keys.items()])
            .agg(*fit_sums("y", "p")))
    status = (F.when(F.col("n") % 2 == 0, "OK").when(F.col("n") % 7 == 0, "Not Converged")
              .otherwise("N/A"))
    return sums.select(*keys, *[c.alias(f"{m}_log") for m, c in score_columns().items()],
                       (F.col("n") / F.lit(1000.0)).alias("training_time_secs"),
                       status.alias("convergence_status"))


def scores_sql(y: str = "y", p: str = "p") -> str:
    """Score aggregates as SQL: R2, RMSE, PBIAS, NSE."""
    sse, sst = f"sum(({p} - {y}) * ({p} - {y}))", f"(var_pop({y}) * count(*))"
    return (f"CASE WHEN count(*) < 2 THEN NULL WHEN {sst} > 0 THEN 1 - {sse} / {sst} "
            f"WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END AS R2, sqrt({sse} / count(*)) AS RMSE, "
            f"100 * sum({p} - {y}) / NULLIF(sum({y}), 0) AS PBIAS, "
            f"CASE WHEN {sst} > 0 THEN 1 - {sse} / {sst} END AS NSE")


FOLDS = f"""fold_scores AS (
 SELECT CASE l_linenumber % 3 WHEN 0 THEN '{MODELS[0]}' WHEN 1 THEN '{MODELS[1]}' ELSE '{MODELS[2]}' END AS model,
  'EXP_' || n_regionkey AS base_experiment_id,
  CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 4 END AS cluster_id,
  l_orderkey % 5 + 1 AS fold, count(*) AS n, {scores_sql()} FROM pred GROUP BY 1, 2, 3, 4),
fold_results AS (
 SELECT model, base_experiment_id, cluster_id, fold, R2 AS R2_log, RMSE AS RMSE_log, PBIAS AS PBIAS_log,
  NSE AS NSE_log, n / CAST(1000 AS DOUBLE) AS training_time_secs,
  CASE WHEN n % 2 = 0 THEN 'OK' WHEN n % 7 = 0 THEN 'Not Converged' ELSE 'N/A' END AS convergence_status
 FROM fold_scores)"""

_NEEDS = {"wq": [WQ], "rain": [RAIN], "temp": [TEMP], "basin": [BASIN], "basin_all": [BASIN_ALL],
          "inherited": [BASIN, INHERITED], "pred": [WQ, PRED], "folds": [WQ, PRED, FOLDS]}


def sql(views: str, *more: str) -> str:
    """``WITH`` list of the named views and extra expressions; the last item is the query."""
    parts: list[str] = []
    for view in views.split():
        parts += [p for p in _NEEDS[view] if p not in parts]
    parts += list(more[:-1])
    return "WITH " + ",\n".join(parts) + "\n" + more[-1] if parts else more[-1]


def r(expression: str, digits: int = 4) -> str:
    """Round half up on a decimal, six digits kept first, as ``round_to`` does."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,{digits + 6})), {digits}) AS DOUBLE)"
