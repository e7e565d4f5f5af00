"""Cleaning, keys and schema operators on the sample view."""

from __future__ import annotations

from pyspark.sql import functions as F

from checkviews.catalog import query
from checkviews.views import KEY, ROLES, VARIABLES, r, sql, table, wq
from rillwater.config import BASIN_PREFIXES, OTHER_BASIN
from rillwater.functions.keys import basin_of
from rillwater.operators import cleaning, summaries
from rillwater.sources import sinks

_keys = ", ".join(KEY)


@query("clean_numeric", sql("wq", f"""
SELECT station_code, count(TRY_CAST(trim(raw_v1) AS DOUBLE)) AS n_numbers,
 sum(TRY_CAST(trim(raw_v1) AS DOUBLE)) AS total FROM wq GROUP BY station_code"""))
def clean_numeric(spark, sf_dir):
    rows = wq(spark, sf_dir).transform(cleaning.to_numeric, ["raw_v1", "not_there"])
    return rows.groupBy("station_code").agg(F.count("raw_v1").alias("n_numbers"),
                                            F.sum("raw_v1").alias("total"))


@query("sentinels", sql("wq", """
SELECT CASE WHEN trim(raw_v1) NOT IN ('N/D', 's/d', 'S/D', '-', '') THEN raw_v1 END AS cell,
 count(*) AS n_rows FROM wq GROUP BY 1"""))
def sentinels(spark, sf_dir):
    rows = wq(spark, sf_dir).transform(cleaning.blank_sentinels, ["raw_v1"])
    return rows.groupBy(F.col("raw_v1").alias("cell")).agg(F.count("*").alias("n_rows"))


@query("excel_dates", sql("wq", f"""
SELECT {_keys}, strftime(TIMESTAMP '1899-12-30 00:00:00'
 + to_microseconds(CAST(date_serial * 86400000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS instant FROM wq"""))
def excel_dates(spark, sf_dir):
    rows = wq(spark, sf_dir).transform(cleaning.parse_dates, "date_serial")
    return rows.select(*KEY, F.date_format("date_serial", "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query("text_dates", sql("wq", """
SELECT strftime(CASE WHEN l_partkey % 10 <> 3 THEN date END, '%Y-%m-%d') AS day, count(*) AS n_rows
FROM wq GROUP BY 1"""))
def text_dates(spark, sf_dir):
    text = F.when(F.col("l_partkey") % 10 == 3, "31/31/1999") \
        .when(F.col("l_partkey") % 2 == 0, F.date_format("date", "dd/MM/yyyy")) \
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
    rows = wq(spark, sf_dir).withColumn("date", text).transform(
        cleaning.parse_dates, "date", ["dd/MM/yyyy"])
    return rows.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n_rows"))


@query("normalized_names", """
SELECT l_suppkey AS estación_id, CAST(sum(l_quantity) AS DOUBLE) AS caudal_m3_s, count(*) AS temperatura_c
FROM lineitem GROUP BY l_suppkey""")
def normalized_names(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("Estación ID")).agg(
        F.sum("l_quantity").alias("Caudal (m3/s)"), F.count("*").alias("_Temperatura (°C)"))
    return rows.transform(cleaning.normalize_columns)


@query("renamed_column", """
SELECT o_orderdate AS date, count(*) AS n_rows FROM orders GROUP BY o_orderdate""")
def renamed_column(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").transform(cleaning.rename_containing, "orderdate", "date")
    return rows.groupBy("date").agg(F.count("*").alias("n_rows"))


@query("clean_keys", sql("wq", """
SELECT upper(trim(station_raw)) AS station_raw, count(*) AS n_rows FROM wq GROUP BY 1"""))
def clean_keys(spark, sf_dir):
    rows = wq(spark, sf_dir).transform(cleaning.clean_keys, "station_raw")
    return rows.groupBy("station_raw").agg(F.count("*").alias("n_rows"))


def _present_sql(columns, condition="true"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n_values FROM wq HAVING {condition.format(c=c)}"
        for c in columns)


_SHEET = ["station_code", "date", "target", *VARIABLES]


@query("drop_empty", sql("wq", _present_sql(_SHEET)))
def drop_empty(spark, sf_dir):
    rows = wq(spark, sf_dir).select(*_SHEET, "empty").transform(cleaning.drop_empty)
    return summaries.completeness(rows).select("variable", "n_values")


@query("missing_threshold", sql("wq", _present_sql(
    _SHEET, "count({c}) >= count(*) * 0.5 OR '{c}' IN ('station_code', 'date', 'v6')")))
def missing_threshold(spark, sf_dir):
    rows = wq(spark, sf_dir).select(*_SHEET, "empty").transform(
        cleaning.drop_sparse, 0.5, ["station_code", "date", "v6"])
    return summaries.completeness(rows).select("variable", "n_values")


_cases = " ".join(f"WHEN starts_with(upper(trim(code)), '{p}') THEN '{b}'" for p, b in BASIN_PREFIXES)


@query("prefix_class", sql("wq", f"""codes AS (
 SELECT CASE l_suppkey % 9 WHEN 0 THEN 'MN' WHEN 1 THEN ' mo' WHEN 2 THEN 'AMO' WHEN 3 THEN 'P'
  WHEN 4 THEN '99' WHEN 5 THEN 'lp' WHEN 6 THEN 'X' WHEN 7 THEN 'M' ELSE 'CDCH' END || l_suppkey AS code
 FROM lineitem)""", f"""
SELECT CASE {_cases} ELSE '{OTHER_BASIN}' END AS basin, count(*) AS n_rows FROM codes GROUP BY 1"""))
def prefix_class(spark, sf_dir):
    prefixes = F.array(*[F.lit(p) for p in ("MN", " mo", "AMO", "P", "99", "lp", "X", "M", "CDCH")])
    code = F.concat(F.element_at(prefixes, (F.col("l_suppkey") % 9 + 1).cast("int")),
                    F.col("l_suppkey").cast("string"))
    return (table(spark, sf_dir, "lineitem").groupBy(basin_of(code).alias("basin"))
            .agg(F.count("*").alias("n_rows")))


@query("fill_constants", sql("wq", """
SELECT station_code, sum(coalesce(v1, 0)) AS v1, sum(coalesce(v5, 0)) AS v5 FROM wq GROUP BY 1"""))
def fill_constants(spark, sf_dir):
    rows = wq(spark, sf_dir).transform(cleaning.fill_constants, {"v1": 0.0, "v5": 0.0, "none": 0.0})
    return rows.groupBy("station_code").agg(F.sum("v1").alias("v1"), F.sum("v5").alias("v5"))


@query("round_numeric", sql("wq", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('v4', 2)} AS v4, {r('v6', 2)} AS v6 FROM wq"""))
def round_numeric(spark, sf_dir):
    return wq(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    "v4", "v6").transform(cleaning.round_numeric, 2)


@query("infer_features", """
SELECT 'lineitem' AS source, unnest(['l_orderkey', 'l_partkey', 'l_linenumber', 'l_quantity',
 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, (SELECT count(*) FROM lineitem) AS n_values""")
def infer_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    features = cleaning.infer_features(rows, ["l_suppkey"])
    counted = summaries.completeness(rows, features)
    return counted.select(F.lit("lineitem").alias("source"), F.col("variable").alias("feature"),
                          "n_values")


@query("select_existing", sql("wq", """
SELECT station_code, basin, date, target, v1, v2 FROM wq"""))
def select_existing(spark, sf_dir):
    return sinks.snapshot(wq(spark, sf_dir), ROLES, ["v1", "not_there", "v2"])


@query("texts_to_numeric", sql("wq", """
SELECT station_code, sum(TRY_CAST(trim(raw_v1) AS DOUBLE)) AS raw_v1 FROM wq GROUP BY 1"""))
def texts_to_numeric(spark, sf_dir):
    rows = wq(spark, sf_dir).select("station_code", "basin", "raw_v1").transform(
        cleaning.texts_to_numeric, ["station_code", "basin"])
    return rows.groupBy("station_code").agg(F.sum("raw_v1").alias("raw_v1"))


@query("clean_samples", sql("wq", """
SELECT upper(trim(station_raw)) AS station_code, count(*) AS n_rows,
 count(TRY_CAST(trim(raw_v1) AS DOUBLE)) AS n_v1, min(date) AS first_date, max(date) AS last_date
FROM wq GROUP BY 1"""))
def clean_samples(spark, sf_dir):
    """A raw sheet, all text, through the whole cleaning chain."""
    raw = wq(spark, sf_dir).select(
        F.col("station_raw").alias("Station Code"), F.col("basin").alias("Basin"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("Date"),
        F.col("target").cast("string").alias("Target"), F.col("raw_v1").alias("V1"))
    rows = cleaning.require_columns(cleaning.clean_samples(raw, ROLES), ROLES)
    return rows.groupBy("station_code").agg(
        F.count("*").alias("n_rows"), F.count("v1").alias("n_v1"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
