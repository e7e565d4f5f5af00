"""What source files hold, remembered by file, so that finding out what changed costs the changed files only.

A manifest is a small table: path, length, time of change, rows, and two sums over the hashes of the rows. The sums
of all files added up identify the content, whatever the order of rows and however they are cut into files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwater.sources.sinks import finished

SCHEMA = "path string, length bigint, changed timestamp, n_rows bigint, mixed bigint, summed decimal(38,0)"


class Fingerprint(NamedTuple):
    digest: str
    scanned: list[str]
    n_files: int


def source_files(spark: SparkSession, root: str, files: str = "*.parquet") -> DataFrame:
    """(path, length, changed) of the files below a folder, or of the one file; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(root)
    return listed.select("path", "length", F.col("modificationTime").alias("changed"))


def _versions(spark: SparkSession, manifest: str) -> list[int]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and finished(spark, f"{manifest}/{n}"))


def _sums(rows: DataFrame) -> DataFrame:
    """Rows and sums by file. Hashes are added in pieces before files meet, so a large file is no hot key."""
    columns = [c for c in rows.columns]
    return (rows.select(F.col("_metadata.file_path").alias("path"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("h"))
            .groupBy("path").agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("mixed"),
                                 F.sum(F.col("h").cast("decimal(28,0)")).cast("decimal(38,0)").alias("summed")))


def content_fingerprint(spark: SparkSession, root: str, manifest: str, files: str = "*.parquet",
                        read: Callable[[SparkSession, Sequence[str]], DataFrame] | None = None) -> Fingerprint:
    """Identifies what the files below ``root`` hold, and brings the manifest in the folder ``manifest`` up to date.

    Only files whose path, length or time of change is not in the manifest are scanned; files that are gone are left
    out. ``read`` makes a table of a list of paths (parquet unless given); its columns should not depend on the files
    in the list. A file rewritten to the same length within its time stamp's precision goes unnoticed. The new manifest
    is a new folder, so one that is cut off is not taken for a whole one.
    """
    read = read or (lambda s, paths: s.read.parquet(*paths))
    listed = source_files(spark, root, files)
    versions = _versions(spark, manifest)
    known = (spark.read.schema(SCHEMA).parquet(f"{manifest}/{versions[-1]}") if versions
             else spark.createDataFrame([], SCHEMA))
    same = ["path", "length", "changed"]
    fresh = listed.join(known, same, "left_anti")
    changed = sorted(r["path"] for r in fresh.select("path").collect())
    kept = known.join(listed, same, "left_semi")
    if changed or kept.count() < known.count() or not versions:
        table = kept.select("path", "length", "changed", "n_rows", "mixed", "summed")
        if changed:
            plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
            # Both names are URIs, but the scan escapes blanks and the listing does not.
            sums = _sums(read(spark, changed)).select(plain(F.url_decode(F.regexp_replace("path", r"\+", "%2B"))).alias("plain"),
                                                      "n_rows", "mixed", "summed")
            added = (fresh.withColumn("plain", plain(F.col("path"))).join(sums, "plain", "left")
                     .select(*same, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("mixed", F.lit(0)).alias("mixed"),
                             F.coalesce("summed", F.lit(0).cast("decimal(38,0)")).alias("summed")))
            table = table.unionByName(added)
        path = f"{manifest}/{(versions[-1] if versions else 0) + 1}"
        table.write.mode("overwrite").parquet(path)
        known = spark.read.schema(SCHEMA).parquet(path)
    row = known.agg(F.sum("n_rows"), F.bit_xor("mixed"), F.sum("summed"), F.count("*")).first()
    return Fingerprint("-".join(str(v or 0) for v in row[:3]), changed, row[3])
