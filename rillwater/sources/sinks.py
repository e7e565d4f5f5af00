"""Writers, the result cache, and the check of what was written."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rillwater.config import Roles
from rillwater.operators.cleaning import round_numeric, select_existing, texts_to_numeric
from rillwater.plans.keep import store

# Fixed names of exported tables; columns that stay text in the parquet export.
EXPORT_NAME = "datos_completos"
TEXT_COLUMNS = ("station_code", "basin", "geometry", "crs")
REQUIRED_COLUMNS = ("station_code", "basin")
EXPORT_DIGITS = 4


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, one file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_two_headers(df: DataFrame, index: str, path: str) -> None:
    """One line per row under two header lines: the name before the last underscore, and the rest.

    For reports of a few rows, which go into one file.
    """
    names = [c for c in df.columns if c != index]
    heads = [[c.rpartition("_")[k] for c in names] for k in (0, 2)]
    top = "\n".join([",".join(["", *h]) for h in heads] + [index + "," * len(names)])
    quoted = F.concat(F.lit('"'), F.replace(F.col(index), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", quoted, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    df.agg(F.concat(F.lit(top + "\n"), lines).alias("value")).write.mode("overwrite").text(path)


# Characters that Spark escapes in names of partition folders.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as programs name it, None if it lies in a store that only Hadoop opens."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store_of = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store_of.makeQualified(where).toUri()
    return found.getPath() if found.getScheme() == "file" else None


def write_folders(df: DataFrame, folder: str, path: str) -> None:
    """One text file ``part-*`` per row in a folder ``<folder>=<its value>``; the other column is the text.

    On a mounted file system the tasks write the files themselves: Hadoop's local file system starts two processes
    for each file it makes, and for many small files that is most of the time. A file appears whole or not at all.
    """
    (text,) = [c for c in df.columns if c != folder]
    root = _mounted(df.sparkSession, path)
    if root is None:
        df.write.partitionBy(folder).text(path)
        return

    def put(rows: Iterable[Row]) -> None:
        for row in rows:
            value = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", row[folder])
            place = os.path.join(root, f"{folder}={value}")
            os.makedirs(place, exist_ok=True)
            unfinished = os.path.join(place, f"_{uuid.uuid4().hex}")
            with open(unfinished, "w", encoding="utf-8", newline="") as file:
                file.write(row[text] + "\n")
            os.replace(unfinished, os.path.join(place, "part-00000.txt"))

    df.foreachPartition(put)


def export_tables(df: DataFrame, folder: str, name: str = EXPORT_NAME,
                  keep_text: Sequence[str] = TEXT_COLUMNS) -> None:
    """Parquet with numbers in number columns, and CSV as it is; 4 decimals in both."""
    rows = store(df, "export")  # what is behind the table runs once for both
    export_parquet(rows, folder, name, keep_text)
    write_csv(rows.transform(round_numeric, EXPORT_DIGITS), f"{folder}/{name}.csv")


def export_parquet(df: DataFrame, folder: str, name: str = EXPORT_NAME,
                   keep_text: Sequence[str] = TEXT_COLUMNS) -> None:
    """The parquet part of ``export_tables`` alone."""
    (df.transform(texts_to_numeric, keep_text).transform(round_numeric, EXPORT_DIGITS)
     .write.mode("overwrite").parquet(f"{folder}/{name}.parquet"))


def excess_decimals(df: DataFrame, digits: int = EXPORT_DIGITS) -> DataFrame:
    """One row: number of rows, and per floating column the cells with more decimals."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    over = lambda c: F.abs(F.col(f"`{c}`") - F.round(F.col(f"`{c}`"), digits)) > 1e-9
    return df.agg(F.count("*").alias("n_rows"),
                  *[F.sum(F.coalesce(over(c), F.lit(False)).cast("bigint")).alias(c)
                    for c in floats])


def check_export(spark: SparkSession, folder: str, name: str = EXPORT_NAME,
                 required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    """Problems of an export: missing, empty, lacking columns, too many decimals."""
    problems = []
    for kind in ("csv", "parquet"):
        try:
            reader = spark.read.option("header", True)
            df = reader.csv(f"{folder}/{name}.csv") if kind == "csv" else \
                spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            problems.append(f"{kind}: missing")
            continue
        lacking = sorted(set(required) - set(df.columns))
        if lacking:
            problems.append(f"{kind}: lacks {', '.join(lacking)}")
        row = excess_decimals(df).first()
        if row["n_rows"] == 0:
            problems.append(f"{kind}: empty")
        if kind == "parquet":
            problems += [f"parquet: {c} has more than {EXPORT_DIGITS} decimals"
                         for c, n in row.asDict().items() if c != "n_rows" and n]
    return problems


def snapshot(df: DataFrame, roles: Roles, features: Sequence[str]) -> DataFrame:
    """The columns a run worked on: metadata, target and the features that exist."""
    return select_existing(df, dict.fromkeys([*roles.metadata, roles.target, *features]))


def save_model(model: PipelineModel, path: str, features: Sequence[str]) -> None:
    """Fitted pipeline (scaler included) and the feature list beside it."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    rows = [(i, f) for i, f in enumerate(features)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return PipelineModel.load(f"{path}/pipeline"), [r["feature"] for r in rows]


def input_fingerprint(df: DataFrame) -> str:
    """Identifies the content of a table regardless of row order."""
    row = df.select(F.xxhash64(*df.columns).alias("h")).agg(
        F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return "-".join(str(v) for v in row)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end; a folder without that mark counts as missing."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def cached_result(spark: SparkSession, folder: str, key: Sequence[object],
                  build: Callable[[], DataFrame]) -> DataFrame:
    """Stored result for a key, built and stored on first use."""
    digest = hashlib.sha256("\x1f".join(map(str, key)).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{digest}"
    if not finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
