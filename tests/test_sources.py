import os

import pytest
from pyspark.sql import functions as F

from rillwater.config import Experiment
from rillwater.operators import cleaning, summaries
from rillwater.sources import discovery, sinks, tables


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_latin_gauge_file(spark, tmp_path):
    path = str(tmp_path / "rain.txt")
    write(path, "Fecha\tEstación Ñu (mm)\n36526\t1.5\n36527\ts/d\n", "latin-1")
    df = tables.read_gauges(spark, path).transform(cleaning.normalize_columns)
    assert df.columns == ["fecha", "estación_ñu_mm"] and [r[1] for r in df.collect()] == ["1.5", "s/d"]


def test_two_headers_in_every_file(spark, tmp_path):
    for name in ("a", "b"):
        write(str(tmp_path / "in" / f"{name}.txt"), "Est\tUno\t\nFecha\tTemperatura media\tHeliofania\n"
              f"2020-01-01\t1{name}\t\n2020-01-02\t\t5\n")
    df = tables.read_two_headers(spark, str(tmp_path / "in"))
    assert df.columns == ["est_fecha", "uno_temperatura media", "heliofania"]
    assert df.count() == 4
    assert cleaning.find_column(df, "fecha") == "est_fecha"


def test_one_line_is_not_enough(spark, tmp_path):
    path = str(tmp_path / "short.txt")
    write(path, "a\tb\n")
    with pytest.raises(ValueError):
        tables.read_two_headers(spark, path)


def test_parameter_files_at_any_depth(spark, tmp_path):
    body = 'Parameter,Value,geometry,crs\narea,1.5,"POINT (0 0)",EPSG:32721\nslope,bad,,\narea,2.5,,\n'
    write(str(tmp_path / "x" / "y" / "report_MO1.csv"), body)
    write(str(tmp_path / "report_LP2.csv"), body)
    write(str(tmp_path / "notes.csv"), "nothing\n")
    rows = discovery.read_basin_parameters(spark, str(tmp_path)).collect()
    assert {(r["station_code"], r["basin"]) for r in rows} == {("MO1", "Arroyo Molino"), ("LP2", "Arroyo Las Piedras")}
    from rillwater.operators.basins import pivot_parameters
    wide = pivot_parameters(discovery.read_basin_parameters(spark, str(tmp_path)), ["station_code"], "line",
                            ["area", "slope"]).orderBy("station_code").collect()
    assert [tuple(r) for r in wide] == [("LP2", 2.5, None), ("MO1", 2.5, None)]


def test_many_small_files_without_a_process_each(spark, tmp_path):
    head = "Parameter,Value,geometry,crs\n"
    names = [f"MO{n}" for n in range(300)] + ["a b", "100%", "x=y:ñ/['z"]
    rows = spark.createDataFrame([(f"report_{n}", f'{head}area,{i}.5,"POINT (0, 0)",\nslope,,"",E') for i, n in enumerate(names)], "file string, value string")
    path = str(tmp_path / "mine")
    for _ in range(2):  # as a task that runs again does
        sinks.write_folders(rows.repartition(7), "file", path)
    # Files of Hadoop's local file system have checksums beside them, each made with a process of its own.
    assert {f for _, _, files in os.walk(path) for f in files} == {"part-00000.txt"} and len(os.listdir(path)) == len(names)
    read = lambda at: sorted((tuple(r)[:-1] for r in discovery.read_basin_parameters(
        spark, at, files="part-*", pattern=r"file=report_([^/]+)/").collect()), key=str)
    rows.write.partitionBy("file").text(str(tmp_path / "spark"))
    got = read(path)
    assert got == read(str(tmp_path / "spark")) and {"MO7", "a b"} < {r[0] for r in got} and len(got) == 2 * len(names)
    assert sorted(os.listdir(path)) == sorted(f for f in os.listdir(tmp_path / "spark") if f.startswith("file="))


def test_summaries_below_run_folders(spark, tmp_path):
    good = ",R2_log,R2_log,training_time_secs\n,mean,std,mean\nmodel,,,\nRidge,0.5,0.1,2\nForest,0.7,,3\n"
    write(str(tmp_path / "run1" / "summary_results.csv"), good)
    write(str(tmp_path / "deep" / "run2" / "summary_results.csv"), ",training_time_secs\n,mean\nRidge,9\n")
    write(str(tmp_path / "bad" / "summary_results.csv"), "only one line\n")
    write(str(tmp_path / "run1" / "other.csv"), good)
    metrics = ["R2_log_mean", "R2_log_std", "training_time_secs_mean"]
    rows = {(r["experiment_id"], r["model"]): tuple(r)[2:] for r in
            discovery.discover_summaries(spark, str(tmp_path), metrics).collect()}
    assert rows == {("run1", "Ridge"): (0.5, 0.1, 2.0), ("run1", "Forest"): (0.7, None, 3.0),
                    ("run2", "Ridge"): (None, None, 9.0)}


def test_first_experiment_and_first_run_count(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    for run in ("2_EXP_A", "1_EXP_A", "3_EXP_AB", "4_OTHER"):
        sinks.write_csv(df, str(tmp_path / run / discovery.SNAPSHOT_DIR))
    known = [Experiment("EXP_A", "Ridge", ()), Experiment("EXP_AB", "Ridge", (), validation_strategy="kfold")]
    found = discovery.discover_runs(spark, str(tmp_path), known)
    assert {r["run_id"]: r["experiment"] for r in found.collect()} == {
        "1_EXP_A": "EXP_A", "2_EXP_A": "EXP_A", "3_EXP_AB": "EXP_A"}
    assert [(r["strategy"], r["run_id"]) for r in discovery.first_run_per_strategy(found).collect()] == [
        ("time_series_cv", "1_EXP_A")]


def test_export_and_its_check(spark, tmp_path):
    df = spark.createDataFrame([("s", "b", 1.23456789, "7,5"), ("s", "b", None, "8.25")],
                               "station_code string, basin string, x double, t string")
    folder = str(tmp_path / "out")
    assert sinks.check_export(spark, folder) == ["csv: missing", "parquet: missing"]
    sinks.export_tables(df, folder)
    assert sinks.check_export(spark, folder) == []
    back = spark.read.parquet(f"{folder}/{sinks.EXPORT_NAME}.parquet").orderBy("x").collect()
    assert [(r["x"], r["t"]) for r in back] == [(None, 8.25), (1.2346, None)]
    df.drop("basin").write.mode("overwrite").parquet(f"{folder}/{sinks.EXPORT_NAME}.parquet")
    assert sinks.check_export(spark, folder) == ["parquet: lacks basin", "parquet: x has more than 4 decimals"]
    df.where("false").write.mode("overwrite").parquet(f"{folder}/{sinks.EXPORT_NAME}.parquet")
    assert sinks.check_export(spark, folder) == ["parquet: empty"]


def test_cached_result_is_built_once_per_key(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    folder = str(tmp_path / "cache")
    for _ in range(2):
        assert sinks.cached_result(spark, folder, ["k", 3], build).count() == 3
    sinks.cached_result(spark, folder, ["k", 4], build)
    assert len(calls) == 2


def test_fingerprint_sees_content_not_order(spark):
    a = spark.range(100)
    assert sinks.input_fingerprint(a) == sinks.input_fingerprint(a.repartition(7))
    assert sinks.input_fingerprint(a) != sinks.input_fingerprint(spark.range(101))


def test_presence_of_columns_in_reports(spark):
    df = spark.createDataFrame([("s", "b", None, 1.0)], "station_code string, basin string, t double, a double")
    from rillwater.config import Roles
    row = summaries.viability_report(df, Roles(target="t"), ["a"]).first()
    assert row.asDict() == {"station_code": "s", "basin": "b", "total_muestras": 1, "muestras_con_target": 0,
                            "t_pct_completo": 0.0, "a_pct_completo": 100.0}


def test_all_lines_and_quoted_cells_of_a_summary_are_read(spark, tmp_path):
    run = tmp_path / "EXP_1_20240101"
    run.mkdir()
    lines = [",R2_log,R2_log", ",mean,std", "model,,", '"a, ""b""",0.5,0.1'] + [f"m{i},{i},1" for i in range(1_000_010)]
    (run / "summary_results.csv").write_text("\n".join(lines))
    for name, text in (("EMPTY", ""), ("SHORT", ",a\n,b\n"), ("BARE", ",a\n,b\nmodel,\n"), ("CUT", ",a,c\n,b,d\nm,1,2\nn,1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary_results.csv").write_text(text)
    found = discovery.discover_summaries(spark, str(tmp_path), ["R2_log_mean"])
    assert found.count() == 1_000_013
    assert found.where("experiment_id = 'EXP_1_20240101' and model = 'a, \"b\"' and R2_log_mean = 0.5").count() == 1
    skipped = {r["experiment_id"]: r["reason"] for r in discovery.skipped_summaries(spark, str(tmp_path)).collect()}
    assert skipped == {"EMPTY": "empty", "SHORT": "no data line", "BARE": "no figures", "CUT": "cut short"}


def test_swapped_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("A\tB\nx\ty\n1\t2\n")
    (tmp_path / "b.tsv").write_text("B\tA\ny\tx\n3\t4\n")
    with pytest.raises(ValueError, match="other headers"):
        tables.read_two_headers(spark, str(tmp_path))
    (tmp_path / "b.tsv").write_text("A\tB\nx\ty\n3\t4\n")
    assert sorted(tuple(r) for r in tables.read_two_headers(spark, str(tmp_path)).collect()) == [("1", "2"), ("3", "4")]


def test_half_written_results_are_built_again(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached_result(spark, str(tmp_path), ["k"], build).count() == 3
    assert len(made) == 1
    (folder,) = tmp_path.iterdir()
    (folder / "_SUCCESS").unlink()
    assert sinks.cached_result(spark, str(tmp_path), ["k"], build).count() == 3 and len(made) == 2


def test_fingerprint_of_many_rows_does_not_overflow(spark):
    large = spark.range(1_000_000).select(F.lit(1).alias("x"))
    assert sinks.input_fingerprint(large) != sinks.input_fingerprint(large.limit(999_999))
