"""Delimited-text scans. Everything is read as text; cleaning sets the types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LATIN = "ISO-8859-1"


def text_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_csv(spark: SparkSession, path, schema: str | StructType | None = None,
             sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with a declared schema, or all text."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_samples(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """Raw sample sheet: all text, so that no cell is lost to inference."""
    return read_csv(spark, path, sep=sep)


def read_gauges(spark: SparkSession, path, encoding: str = LATIN) -> DataFrame:
    """Tab-separated daily rain, one column per gauge."""
    return read_csv(spark, path, sep="\t", encoding=encoding)


def joined_names(first: Sequence[str], second: Sequence[str]) -> list[str]:
    """Two header cells to one name: ``a_b`` in lower case."""
    return ["_".join([a.strip(), b.strip()]).strip("_").strip().lower()
            for a, b in zip(first, second)]


def read_two_headers(spark: SparkSession, path, sep: str = "\t",
                     encoding: str = "UTF-8") -> DataFrame:
    """Delimited text whose first two lines are headers, flattened to one.

    Only the two lines come to the driver. The scan skips the first line of
    every file itself; the second is recognised by its cells. A file whose first
    line differs, or that lacks the second, is an error: its columns would land
    under the names of another one.
    """
    options = {"sep": sep, "encoding": encoding}
    head = spark.read.options(**options).csv(path).limit(2).collect()
    if len(head) < 2:
        raise ValueError("the file has no second header line")
    first, second = [[c or "" for c in row] for row in head]
    lines = spark.read.options(**options).csv(path)

    def equals(cells: Sequence[str]) -> Column:
        same = F.lit(True)
        for name, cell in zip(lines.columns, cells):
            same = same & (F.trim(F.coalesce(F.col(name), F.lit(""))) == cell.strip())
        return F.max(same)

    # Lines of one file may be read by several tasks, so both headers are sought among all of them.
    odd = (lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(equals(first).alias("a"), equals(second).alias("b"))
           .where("not (a and b)").select("file").limit(3).collect())
    if odd:
        raise ValueError(f"other headers than in the first file: {', '.join(r['file'] for r in odd)}")
    names = joined_names(first, second)
    if len(set(names)) < len(names):
        raise ValueError(f"header names collide: {names}")
    rows = spark.read.options(**options).option("header", True).option("enforceSchema", True) \
        .schema(text_schema(names)).csv(path)
    is_header = F.lit(True)
    for name, cell in zip(names, second):
        is_header = is_header & (F.coalesce(F.trim(F.col(f"`{name}`")), F.lit("")) == cell.strip())
    return rows.where(~is_header)
