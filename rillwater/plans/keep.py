"""Keeping intermediate results: small ones in the cache, large ones as tables.

``settle`` is how this package broadcasts: the small side is cached and measured,
and only below ``BROADCAST_BYTES`` is it marked for broadcast. Beyond that the
planner is left to choose, usually a sort-merge join that AQE splits on skewed
keys. No broadcast happens without that check.

``store`` cuts lineage by writing a table into the shared checkpoint folder, so
that the result survives lost executors and later jobs read only the columns
they need.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType

from rillwater.session import shared_folder

# Largest table that is sent to every executor. Hashed it takes about twice as much.
BROADCAST_BYTES = 64 * 1024 * 1024

_settled: list[DataFrame] = []
_stored: list[tuple[SparkSession, str]] = []


def _row_bytes(df: DataFrame) -> Column | None:
    """Upper estimate of a row's size; None for types it cannot judge."""
    size = F.lit(16)
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.lit(8) + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType):
            size = size + F.lit(24) + F.lit(8) * F.greatest(F.size(col), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            return None
        else:
            size = size + F.lit(16)
    return size


def cached(df: DataFrame) -> DataFrame:
    """Cache a reduced table that several steps read."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _settled.append(kept)
    return kept


def settle(df: DataFrame) -> DataFrame:
    """Cache the small side of a join, measure it, and mark it for broadcast if it
    is small.

    Only for tables that are joined as they are or further reduced: the mark
    travels with everything derived from the table.
    """
    kept = cached(df)
    size = _row_bytes(kept)
    if size is None:
        kept.count()
        return kept
    measured = kept.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(kept) if measured <= BROADCAST_BYTES else kept


def settle_all(*tables: DataFrame) -> list[DataFrame]:
    """Settle independent tables side by side; each is a few small jobs."""
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        return list(pool.map(inheritable_thread_target(tables[0].sparkSession)(settle), tables))


def release() -> None:
    """Drop everything ``settle`` and ``cached`` hold."""
    while _settled:
        try:
            _settled.pop().unpersist()
        except Exception:  # the session that owned it is gone
            pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed by ``remove_stored``."""
    folder = f"{shared_folder(spark).rstrip('/')}/rillwater-{spark.sparkContext.applicationId}"
    _stored.append((spark, f"{folder}/{label}-{uuid.uuid4().hex}"))
    return _stored[-1][1]


def stored() -> int:
    """How many tables ``store`` and ``scratch`` have made and not removed."""
    return len(_stored)


def remove_stored(since: int = 0, until: int | None = None) -> None:
    """Delete tables that ``store`` and ``scratch`` made, once their results are used up.

    ``since`` and ``until`` are numbers given by ``stored``: only what was made in between goes.
    """
    gone = _stored[since:until]
    del _stored[since:until]
    for spark, path in reversed(gone):
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session that owned it is gone
            pass


def store(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    ``by`` names a column of few values that gets one folder per value.
    """
    spark: SparkSession = df.sparkSession
    path = scratch(spark, label)
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
