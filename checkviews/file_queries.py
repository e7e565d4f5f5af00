"""Sources and sinks: given tables written out as files and scanned back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checkviews import sheets
from checkviews.catalog import query, rounded
from checkviews.feature_queries import RAIN_DAILY, RAIN_ROLLED, TEMP_DAILY, TEMP_ROLLED, TEMP_NAMES
from checkviews.views import (BASIN_PARAMETERS, GAUGES, ROLES, SEGMENTS, VARIABLES, basin_long,
                              fold_results, r, rain, sql, temperature, wq)
from rillwater.config import RAIN_FEATURES, Experiment
from rillwater.operators import basins, cleaning, reports, summaries, weather
from rillwater.plans.keep import scratch, store
from rillwater.sources import discovery, manifest, sinks, tables, workbooks


@query("gauge_file_scan", sql("rain", RAIN_DAILY, RAIN_ROLLED, "SELECT date, " + ", ".join(
    f"{r(c)} AS {c}" for c in RAIN_FEATURES) + " FROM rain_features"))
def gauge_file_scan(spark, sf_dir):
    """Tab-separated latin-1 rain file with spreadsheet dates, to rolling features."""
    path = scratch(spark, "gauges")
    serial = F.datediff("date", F.lit("1899-12-30").cast("date"))
    names = ["Fecha", *[f"Estación {g} (mm)" for g in GAUGES]]
    rows = rain(spark, sf_dir).select(serial.cast("string"),
                                      *[F.coalesce(F.col(g).cast("string"), F.lit("s/d")) for g in GAUGES])
    rows.toDF(*names).write.option("header", True).option("sep", "\t") \
        .option("encoding", tables.LATIN).csv(path)
    wide = (tables.read_gauges(spark, path).transform(cleaning.normalize_columns)
            .transform(cleaning.rename_containing, "fecha", "date")
            .transform(cleaning.parse_dates, "date"))
    gauges = [c for c in wide.columns if c != "date"]
    return rounded(weather.rain_features(cleaning.to_numeric(wide, gauges)))


@query("two_header_scan", sql("temp", TEMP_DAILY, TEMP_ROLLED, "SELECT date, " + ", ".join(
    f"{r(c)} AS {c}" for c in (*TEMP_NAMES, "horas_sol")) + " FROM temp_features"))
def two_header_scan(spark, sf_dir):
    """Two header lines in every file; columns found by parts of their names."""
    path = scratch(spark, "two-headers")
    wide = temperature(spark, sf_dir)
    lines = wide.select(F.concat_ws("\t", F.date_format("date", "yyyy-MM-dd"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("s/d")) for c in wide.columns if c != "date"]).alias("value"))
    first = "\t".join(["Estacion", *SEGMENTS, "Heliofania"])
    second = "\t".join(["Fecha", *["Temperatura media"] * len(SEGMENTS), "horas"])
    # One file per year, each with both headers on top.
    years = lines.groupBy(F.substring("value", 1, 4).alias("year")).agg(
        F.concat(F.lit(f"{first}\n{second}\n"), F.array_join(F.array_sort(F.collect_list("value")), "\n"))
        .alias("value"))
    years.repartition(8, "year").write.partitionBy("year").text(path)
    read = tables.read_two_headers(spark, f"{path}/*")
    return rounded(weather.temperature_features(read, names=TEMP_NAMES))


@query("basin_file_scan", sql("basin_all", f"""
SELECT station_code, 'Otras Cuencas' AS basin, 'EPSG:32721' AS crs,
 {', '.join(f'{r(c)} AS {c}' for c in BASIN_PARAMETERS)} FROM basin_wide"""))
def basin_file_scan(spark, sf_dir):
    """Parameter files found at any depth, station from the file path, pivoted."""
    path = scratch(spark, "parameters")
    long = basin_long(spark, sf_dir, holes=False)
    names = ("Parameter", "Value", "geometry", "crs")
    rows = long.withColumns({"geometry": F.lit("POINT (0 0)"), "crs": F.lit("EPSG:32721")})
    lines = F.array_sort(F.collect_list(F.struct("line", F.to_csv(F.struct(*names)).alias("text"))))
    # The texts are small and the files many: dealt by bytes, one task would write most of them.
    files = rows.select(F.concat(F.lit("report_"), "station_code").alias("file"), "line", *names) \
        .repartition(4 * spark.sparkContext.defaultParallelism, "file").groupBy("file").agg(
        F.concat(F.lit(",".join(names) + "\n"), F.array_join(lines["text"], "\n")).alias("value"))
    sinks.write_folders(files, "file", path)
    rows = discovery.read_basin_parameters(spark, path, files="part-*",
                                           pattern=r"file=report_([^/]+)/")
    wide = basins.pivot_parameters(rows, ["station_code", "basin", "crs"], "line", BASIN_PARAMETERS)
    return rounded(wide)


@query("sample_sheet_scan", sql("wq", """
SELECT station_code, count(*) AS n_rows, count(target) AS n_target,
 count(TRY_CAST(trim(raw_v1) AS DOUBLE)) AS n_v1, min(date) AS first_date FROM wq GROUP BY station_code"""))
def sample_sheet_scan(spark, sf_dir):
    """Raw sheet written as CSV with sentinels, scanned as text, cleaned."""
    path = scratch(spark, "sheet")
    serial = F.datediff("date", F.lit("1899-12-30").cast("date"))
    sinks.write_csv(wq(spark, sf_dir).select(
        F.col("station_raw").alias("Station Code"), F.col("basin").alias("Basin"), serial.alias("Date"),
        F.coalesce(F.col("target").cast("string"), F.lit("N/D")).alias("Target"),
        F.col("raw_v1").alias("V1")), path)
    rows = cleaning.clean_samples(tables.read_samples(spark, path), ROLES)
    return rows.groupBy("station_code").agg(
        F.count("*").alias("n_rows"), F.count("target").alias("n_target"),
        F.count("v1").alias("n_v1"), F.min("date").alias("first_date"))


@query("export_roundtrip", sql("wq", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) AS n_rows, count({c}) AS n_values FROM wq" for c in VARIABLES)
    + " UNION ALL SELECT 'raw_v1', count(*), count(TRY_CAST(trim(raw_v1) AS DOUBLE)) FROM wq"))
def export_roundtrip(spark, sf_dir):
    """Parquet and CSV export, the export check, and the parquet scanned back."""
    path = scratch(spark, "export")
    sinks.export_tables(wq(spark, sf_dir).select("station_code", "basin", *VARIABLES, "raw_v1"), path)
    problems = sinks.check_export(spark, path)
    if problems:
        raise AssertionError(problems)
    back = spark.read.parquet(f"{path}/{sinks.EXPORT_NAME}.parquet")
    return summaries.completeness(back, [*VARIABLES, "raw_v1"]).select("variable", "n_rows", "n_values")


@query("run_summaries_scan", sql("folds", f"""
SELECT base_experiment_id AS experiment_id, model, {r('avg(R2_log)')} AS R2_log_mean, {r('avg(RMSE_log)')} AS RMSE_log_mean,
 {r('avg(training_time_secs)')} AS training_time_secs_mean FROM fold_results GROUP BY 1, 2"""))
def run_summaries_scan(spark, sf_dir):
    """Summaries with two header lines below run folders, found and ranked."""
    path = scratch(spark, "runs")
    metrics = ("R2_log", "RMSE_log", "training_time_secs")
    means = fold_results(spark, sf_dir).groupBy("base_experiment_id", "model").agg(
        *[F.avg(c).alias(c) for c in metrics])
    head = f",{','.join(metrics)}\n,{','.join(['mean'] * len(metrics))}\nmodel{',' * len(metrics)}\n"
    body = means.select("base_experiment_id", F.concat_ws(",", "model", *metrics).alias("value"))
    (body.groupBy("base_experiment_id")
     .agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("value")), "\n")).alias("value"))
     .write.partitionBy("base_experiment_id").text(path))
    found = discovery.discover_summaries(spark, path, [f"{m}_mean" for m in metrics], files="part-*")
    named = found.withColumn("experiment_id", F.regexp_replace("experiment_id", "^base_experiment_id=", ""))
    return reports.ranked_summaries(named)


@query("run_folders_scan", sql("wq", """
SELECT 'exp=EXP_' || n_regionkey AS run_id, 'EXP_' || n_regionkey AS experiment,
 CASE WHEN n_regionkey % 2 = 0 THEN 'time_series_cv' ELSE 'kfold' END AS strategy,
 n_regionkey = min(n_regionkey) OVER (PARTITION BY n_regionkey % 2) AS stands_for_strategy, count(*) AS n_rows
FROM wq GROUP BY n_regionkey"""))
def run_folders_scan(spark, sf_dir):
    """Snapshots of all runs written out, their folders matched to experiments by
    name, rows counted per run, and the run that stands for each strategy."""
    path = scratch(spark, "folders")
    rows = wq(spark, sf_dir).withColumn("exp", F.concat(F.lit("EXP_"), F.col("n_regionkey").cast("string")))
    rows.select(*ROLES.metadata, ROLES.target, *VARIABLES, "exp").write.partitionBy("exp") \
        .option("header", True).csv(path)
    known = [Experiment(f"EXP_{i}", "Ridge", VARIABLES,
                        validation_strategy="kfold" if i % 2 else "time_series_cv") for i in range(5)]
    runs = discovery.discover_runs(spark, path, known, snapshot=None).drop("data_path").distinct()
    first = discovery.first_run_per_strategy(
        discovery.discover_runs(spark, path, known, snapshot=None)).select("run_id", F.lit(True).alias("first"))
    counts = (tables.read_csv(spark, f"{path}/*").groupBy(
        discovery.folder_name(discovery.file_path()).alias("run_id")).agg(F.count("*").alias("n_rows")))
    return runs.join(first, "run_id", "left").join(counts, "run_id").select(
        "run_id", "experiment", "strategy", F.coalesce("first", F.lit(False)).alias("stands_for_strategy"), "n_rows")


@query("cached_result", sql("wq", "SELECT basin, count(*) AS n_rows FROM wq GROUP BY basin"))
def cached_result(spark, sf_dir):
    """Stored under a key of parameters and input content; the second call reads it."""
    rows = wq(spark, sf_dir).select("basin")
    folder, key = scratch(spark, "cache"), ["basin counts", sinks.input_fingerprint(rows)]
    build = lambda: summaries.counts_by(rows, "basin")
    sinks.cached_result(spark, folder, key, build)
    return sinks.cached_result(spark, folder, key, build)


SHEET_ROWS = 20000
SHEETS_PER_TASK = 8


def _bound(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one file as a workbook; every other file has its columns turned round."""
    file = int(frame["file"].iloc[0])
    names = [c for c in frame.columns if c != "file"][:: -1 if file % 2 else 1]
    cells = [[None if v is None or v != v else v for v in row] for row in frame[names].itertuples(index=False)]
    return pd.DataFrame({"path": [f"sheet-{file}.xlsx"], "content": [sheets.workbook([names, *cells])]})


@query("workbook_scan", sql("wq", """
SELECT station_code, count(*) AS n_rows, count(target) AS n_target, CAST(sum(target) AS DECIMAL(38, 2)) AS sum_target,
 count(TRY_CAST(trim(raw_v1) AS DOUBLE)) AS n_v1, min(date) AS first_date, max(date) AS last_date FROM wq GROUP BY station_code"""))
def workbook_scan(spark, sf_dir):
    """The sample sheet as workbooks of some 20,000 rows each, read back as text and cleaned."""
    rows = wq(spark, sf_dir)
    files = rows.count() // SHEET_ROWS + 1
    serial = F.datediff("date", F.lit("1899-12-30").cast("date"))
    sheet = rows.select(F.col("station_raw").alias("Station Code"), F.col("basin").alias("Basin"), serial.alias("Date"),
                        F.coalesce(F.col("target").cast("string"), F.lit("N/D")).alias("Target"), F.col("raw_v1").alias("V1"),
                        F.pmod(F.xxhash64(*ROLES.sample_key), F.lit(files)).alias("file"))
    # Writing and reading a sheet costs far more than its bytes tell, so tasks are cut by sheets.
    sheet = sheet.repartition(files // SHEETS_PER_TASK + 1, "file")
    books = store(sheet.groupBy("file").applyInPandas(_bound, "path string, content binary"), "workbooks")
    clean = cleaning.clean_samples(workbooks.workbook_rows(books, "data"), ROLES)
    return clean.groupBy("station_code").agg(
        F.count("*").alias("n_rows"), F.count("target").alias("n_target"),
        F.sum(F.col("target").cast("decimal(18,2)")).cast("decimal(38,2)").alias("sum_target"),
        F.count("v1").alias("n_v1"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("source_manifest", sql("wq", """
SELECT basin, count(*) AS n_rows, true AS same_content, 0 AS scanned_again FROM wq GROUP BY basin"""))
def source_manifest(spark, sf_dir):
    """A result kept under the fingerprint of its source files; the second look scans none of them."""
    path, kept, folder = scratch(spark, "source"), scratch(spark, "manifest"), scratch(spark, "cache")
    wq(spark, sf_dir).select("station_code", "basin", "date").write.parquet(path)
    build = lambda: summaries.counts_by(spark.read.parquet(path), "basin")
    first = manifest.content_fingerprint(spark, path, kept)
    sinks.cached_result(spark, folder, ["basin counts", first.digest], build)
    again = manifest.content_fingerprint(spark, path, kept)
    counts = sinks.cached_result(spark, folder, ["basin counts", again.digest], build)
    return counts.select("*", F.lit(first.digest == again.digest).alias("same_content"), F.lit(len(again.scanned)).alias("scanned_again"))
