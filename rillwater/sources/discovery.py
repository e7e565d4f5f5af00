"""Scans over trees of files whose place carries meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwater.config import Experiment
from rillwater.functions.keys import basin_of, first_contained

# Fixed names of the files a run and a basin survey leave behind.
SUMMARY_FILE = "summary_results.csv"
SNAPSHOT_DIR = "datos_usados_en_modelo"
PARAMETER_FILES = "report_*.csv"
PARAMETER_PATTERN = r"report_([^/]+)\.csv$"

PARAMETER_SCHEMA = "Parameter string, Value double, geometry string, crs string"


def file_path() -> Column:
    return F.col("_metadata.file_path")


def folder_name(path: Column, levels_up: int = 1) -> Column:
    """Name of a folder above a file."""
    return F.element_at(F.split(path, "/"), -1 - levels_up)


def read_basin_parameters(spark: SparkSession, root: str, files: str = PARAMETER_FILES,
                          pattern: str = PARAMETER_PATTERN) -> DataFrame:
    """Parameter files ``report_<station>.csv`` at any depth, in long form.

    Other layouts are read by giving their file glob and station pattern. Station comes
    from the file name, basin from its prefix; ``line`` keeps the order of parameters
    inside a file. A damaged file ends the scan with an error, it does not vanish.
    """
    rows = (spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", files)
            .option("header", True).schema(PARAMETER_SCHEMA).csv(root))
    station = F.url_decode(F.regexp_extract(file_path(), pattern, 1))
    return rows.select(station.alias("station_code"), basin_of(station).alias("basin"),
                       F.coalesce("crs", F.lit("Unknown")).alias("crs"), "geometry",
                       "Parameter", "Value", F.monotonically_increasing_id().alias("line"))


def _cells(line: Column) -> Column:
    """Cells of a CSV line; a quoted cell may hold commas, and quotes written twice."""
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    return F.transform(found, lambda c: F.coalesce(plain(c), c))


def _summary_lines(spark: SparkSession, root: str, files: str) -> DataFrame:
    """(file, line, n, at): the lines of all summaries that are not blank, none of them held with another.

    ``at`` orders the lines of a file; ``n`` is 1 and 2 for its first two and null for the others.
    """
    rows = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(root)
            .select(file_path().alias("file"), F.col("value").alias("line"),
                    F.struct(F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("place")).alias("at"))
            .where(F.trim("line") != ""))
    order = Window.partitionBy("file").orderBy("at")
    first = (rows.where(F.col("at.block") == 0).withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2)
             .groupBy("file").agg(F.max(F.when(F.col("n") == 1, F.col("line"))).alias("h1"),
                                  F.max(F.when(F.col("n") == 2, F.col("line"))).alias("h2"), F.max("at").alias("until")))
    return rows.join(first, "file")


def _figures(line: Column) -> Column:
    """Whether a line has a cell besides its name; the line that only names the index has none."""
    cells = _cells(line)
    return F.exists(F.slice(cells, F.lit(2), F.size(cells)), lambda c: F.trim(c) != "")


def files_below(spark: SparkSession, root: str, files: str) -> DataFrame:
    """(file) of every file whose name matches, empty ones included.

    Scans leave files without bytes out of their plans, but Spark's listing, which is spread
    over the cluster where there are many folders, has them.
    """
    listed = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).format("binaryFile")
              .load(root).inputFiles())
    return spark.createDataFrame([(f,) for f in listed], "file string")


def skipped_summaries(spark: SparkSession, root: str, files: str = SUMMARY_FILE) -> DataFrame:
    """(experiment_id, reason) of the summary files that ``discover_summaries`` reads nothing or not everything from.

    ``empty``, ``no data line``, ``no figures``, or ``cut short`` where a line has fewer cells than the headers.
    """
    lines = _summary_lines(spark, root, files)
    data = F.col("at") > F.col("until")
    short = data & (F.size(_cells(F.col("line"))) < F.size(_cells(F.col("h1")))) & _figures(F.col("line"))
    counts = lines.groupBy("file").agg(F.count("*").alias("lines"), F.count(F.when(data & _figures(F.col("line")), 1)).alias("figures"),
                                       F.count(F.when(short, 1)).alias("short"))
    reason = (F.when(F.col("lines").isNull(), "empty").when(F.col("lines") < 3, "no data line")
              .when(F.col("figures") == 0, "no figures").when(F.col("short") > 0, "cut short"))
    plain = F.regexp_replace("file", "^file:/+", "/")
    paths = files_below(spark, root, files).select(plain.alias("plain")).distinct()
    return (paths.join(counts.withColumn("plain", plain), "plain", "left")
            .select(folder_name(F.col("plain")).alias("experiment_id"), reason.alias("reason")).where(F.col("reason").isNotNull()))


def discover_summaries(spark: SparkSession, root: str, metrics: Sequence[str],
                       files: str = SUMMARY_FILE, levels_up: int = 1) -> DataFrame:
    """Every two-header summary below ``root``; the name of a folder above it is the run.

    Summaries saved by ``Run.save`` are folders of that name: give ``<root>/*/summary_results.csv``,
    ``part-*`` and two levels.

    The files hold one line per model. A file without the two headers and a data
    line gives no rows (see ``skipped_summaries``). Cells may be quoted. ``metrics``
    are flat names such as ``R2_log_mean``.
    """
    names = F.transform(F.arrays_zip(_cells(F.col("h1")).alias("a"), _cells(F.col("h2")).alias("b")),
                        lambda h: F.concat(F.trim(h["a"]), F.lit("_"), F.trim(h["b"])))
    data = (_summary_lines(spark, root, files).where((F.col("at") > F.col("until")) & _figures(F.col("line")))
            .select(folder_name(F.col("file"), levels_up).alias("experiment_id"), names.alias("names"), _cells(F.col("line")).alias("cells")))
    value = lambda m: F.try_element_at(F.col("cells"), F.array_position("names", m).cast("int"))
    known = lambda m: F.array_position("names", m) > 0
    return data.select(F.trim(F.col("cells")[0]).alias("model"), "experiment_id", *[
        F.when(known(m), value(m).try_cast("double")).alias(m) for m in metrics])


def read_run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Summaries written by this package: ``<root>/<run>/summary``."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/*/summary")
    return rows.withColumn("experiment_id", folder_name(file_path(), 2))


def discover_runs(spark: SparkSession, root: str, experiments: Sequence[Experiment],
                  snapshot: str | None = SNAPSHOT_DIR) -> DataFrame:
    """Run folders with a snapshot, matched to experiments by name.

    The first experiment whose id is part of the folder name counts. ``snapshot``
    names the folder with the rows inside a run; None if they lie in the run itself.
    """
    parts = files_below(spark, root, "part-*").select(F.col("file").alias("path"))
    if snapshot:
        parts = parts.where(F.col("path").contains(f"/{snapshot}/"))
    runs = parts.select(folder_name(F.col("path"), 2 if snapshot else 1).alias("run_id"),
                        F.regexp_replace("path", "/[^/]*$", "").alias("data_path")).distinct()
    match = first_contained(F.col("run_id"), [e.id for e in experiments])
    strategies = {e.id: e.validation_strategy for e in experiments}
    strategy = F.lit(None).cast("string")
    for name, value in strategies.items():
        strategy = F.when(F.col("experiment") == name, value).otherwise(strategy)
    return (runs.withColumn("experiment", match).where(F.col("experiment").isNotNull())
            .withColumn("strategy", strategy))


def first_run_per_strategy(runs: DataFrame) -> DataFrame:
    """One representative run per strategy: the first by name."""
    return (runs.groupBy("strategy")
            .agg(F.min(F.struct("run_id", "data_path")).alias("first"))
            .select("strategy", "first.run_id", "first.data_path"))
