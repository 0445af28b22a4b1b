"""Tables that are kept by run, as snapshots and over generations; the log of adjustments."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexmill.operators import adjust, run_tables
from vertexmill.plans import fixtures as fx

from test_adjust_many import scene

ROW = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("error_px", T.DoubleType())])


def files(path: Path) -> dict[str, int]:
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("image_id", "error_px").collect()))


def test_replace_one_run(spark, tmp_path):
    path = tmp_path / "errors"
    make = lambda *r: spark.createDataFrame(r, ROW)
    runs = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "run_id long, success boolean")
    assert rows(run_tables.read_run(spark, str(path), ROW, runs)) == []
    for k in (1, 2, 4):
        run_tables.write_run(make((k, 0.5), (k + 10, 1.5)), str(path), k)
    before = files(path)
    run_tables.write_run(make((77, 7.0)), str(path), 2)
    after = files(path)
    same = {f for f in before if not f.startswith("run_id=2/")}
    assert all(after[f] == before[f] for f in same) and not {f for f in before if f.startswith("run_id=2/")} & after.keys()
    read = lambda *a: run_tables.read_run(spark, str(path), ROW, runs, *a)
    assert rows(read(2)) == [(77, 7.0)] and rows(read()) == [(4, 0.5), (14, 1.5)] and rows(read(3)) == [] and read().columns == ["image_id", "error_px", "run_id"]
    assert rows(run_tables.read_run(spark, str(path), ROW, runs.filter("not success"))) == []
    plan = read()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "= 4" in plan
    run_tables.write_run(make(), str(path), 4)
    assert rows(read()) == [] and rows(read(1)) == [(1, 0.5), (11, 1.5)]


def test_snapshot_of_itself(spark, tmp_path):
    path = str(tmp_path / "seeds")
    first = spark.createDataFrame([(1, None), (2, "then")], "image_id long, created_at string")
    run_tables.write_snapshot(first, path, F.lit("now"))
    old = spark.read.parquet(path)
    run_tables.write_snapshot(old.filter("image_id = 2").union(spark.createDataFrame([(3, None)], old.schema)), path, F.lit("later"))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "then"), (3, "later")] and [p.name for p in tmp_path.iterdir()] == ["seeds"]
    with pytest.raises(Exception, match="no such luck"):
        run_tables.write_snapshot(spark.read.parquet(path).select("image_id", F.raise_error(F.lit("no such luck")).cast("string").alias("created_at")), path)
    assert spark.read.parquet(path).count() == 2


def test_points_by_source(spark, tmp_path):
    path = tmp_path / "points"
    points = lambda *r: spark.createDataFrame(r, "point_id long, x double")
    run_tables.write_points(points((1, 1.0)), str(path), "merged")
    run_tables.write_points(points((2, 2.0), (3, 3.0)), str(path))
    kept = {f: t for f, t in files(path).items() if "merged" in f}
    run_tables.write_points(points((4, 4.0)), str(path))
    assert sorted((r.point_id, r.source) for r in spark.read.parquet(str(path)).collect()) == [(1, "merged"), (4, "triangulated")] and kept.items() <= files(path).items()


def test_two_generations_of_files(spark, tmp_path):
    path = str(tmp_path / "features")
    spark.createDataFrame([(1, 5)], "image_id long, legacy int").write.parquet(path)
    spark.createDataFrame([(2, "fast", 0.5), (3, None, None)], "image_id long, mode string, sharpness double").write.mode("append").parquet(path)
    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("mode", T.StringType()), T.StructField("sharpness", T.DoubleType()), T.StructField("added", T.IntegerType())])
    read = run_tables.read_generations(spark, path, schema, ("mode",), {"added": 9})
    assert read.columns == ["image_id", "mode", "sharpness", "added", "legacy"]
    assert sorted(map(tuple, read.collect())) == [(1, "unknown", None, 9, 5), (2, "fast", 0.5, 9, None), (3, "unknown", None, 9, None)]


def test_adjustments_are_logged(spark, tmp_path):
    observations, images, markers = scene(spark)
    run = lambda **kw: run_tables.run_adjustment(observations, images, markers, fx.camera(spark), 0.2, 0, str(tmp_path), adjust.Config(iterations=2, second_pass=False, **kw))
    assert run() == 1
    before = files(tmp_path / "errors")
    with pytest.raises(ValueError, match="unknown loss: none such"):
        run(loss="none such")
    log = {r.run_id: r for r in run_tables.read_runs(spark, str(tmp_path)).collect()}
    assert log.keys() == {1, 2} and log[1].success and log[1].final_cost < log[1].initial_cost and log[1].num_corners == 80 and log[1].error_message is None and log[1].started_at <= log[1].completed_at
    assert log[2].success is False and "unknown loss" in log[2].error_message and files(tmp_path / "errors") == before
    errors = run_tables.read_run(spark, str(tmp_path / "errors"), ROW, run_tables.read_runs(spark, str(tmp_path)))
    assert errors.count() == 80 and {r.run_id for r in errors.select("run_id").distinct().collect()} == {1}
