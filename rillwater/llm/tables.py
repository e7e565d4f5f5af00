"""Reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwater.plans.keep import scratch

ROWS_PER_BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts lineage so that a lost executor costs a file read and not the steps before. Tables
    lie below the application's id and are removed by ``plans.keep.remove_stored``.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """The same table, for a session that hands rows to Python workers in small batches.

    Documents are long: at the usual 10,000 rows a batch holds tens of megabytes, several
    times over on its way into a worker.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS_PER_BATCH:
        conf.set(key, ROWS_PER_BATCH)
    return df
