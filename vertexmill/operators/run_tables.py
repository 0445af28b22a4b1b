"""Tables that are kept: Parquet by run, replaced a partition at a time, snapshots, files of several generations, the run log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexmill.operators import adjust, catalog


def _place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def write_partition(new: DataFrame, path: str, column: str, value: int | str) -> None:
    """Replace the rows of a Parquet table at path whose column has this value with new; files of other values stay as they are. No rows remove the partition."""
    spark = new.sparkSession
    if new.isEmpty():
        store, place = _place(spark, f"{path}/{column}={value}")
        store.delete(place, True)
        return
    kept = new.drop(column).withColumn(column, F.lit(value))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_run(new: DataFrame, path: str, run_id: int) -> None:
    """Replace a run's rows in the table at path."""
    write_partition(new, path, "run_id", run_id)


def read_run(spark: SparkSession, path: str, schema: T.StructType, runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """The rows of a run in the table at path, by default of the latest successful one of runs(run_id, success); none without such a run. Only the run's partition is read.

    schema: the table's columns without run_id.
    """
    whole = T.StructType([*[f for f in schema if f.name != "run_id"], T.StructField("run_id", T.LongType())])
    if run_id is None:
        run_id = catalog.latest_successful(runs).first()[0]  # one row
    if run_id is None or not _exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path).filter(F.col("run_id") == run_id)


def replace_table(new: DataFrame, path: str) -> None:
    """Write new as the whole table at path. It is written beside it first, so new may be made from the old table, and a job that fails leaves that."""
    spark, beside = new.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    new.write.parquet(beside)
    store, made = _place(spark, beside)
    place = _place(spark, path)[1]
    store.delete(place, True)
    if not store.rename(made, place):
        raise OSError(f"could not move {beside} to {path}")


def write_snapshot(new: DataFrame, path: str, now=None) -> None:
    """The whole table at path replaced by new, created_at filled in where it is null."""
    replace_table(catalog.snapshot(new, now), path)


def write_points(new: DataFrame, path: str, source: str = "triangulated") -> None:
    """Replace the points of a source in the table at path, which is kept by source; those of other sources stay."""
    write_partition(new, path, "source", source)


def read_generations(spark: SparkSession, path: str, schema: T.StructType, unknown: Sequence[str] = (), defaults: dict | None = None) -> DataFrame:
    """Files of several generations as one table of schema: columns that older files lack are null, 'unknown' for those named, or their default; columns that schema lacks are kept behind."""
    table = catalog.evolve(spark.read.option("mergeSchema", True).parquet(path), schema, unknown)
    for name, value in (defaults or {}).items():
        table = table.withColumn(name, F.coalesce(name, F.lit(value).cast(schema[name].dataType)))
    return table


LOG = T.StructType([T.StructField(n, t) for n, t in (
    ("run_id", T.LongType()), ("seq", T.LongType()), ("started_at", T.StringType()), ("completed_at", T.StringType()), ("success", T.BooleanType()), ("initial_cost", T.DoubleType()), ("final_cost", T.DoubleType()), ("num_iterations", T.LongType()),
    ("num_outlier_observations", T.LongType()), ("mean_error_px", T.DoubleType()), ("median_error_px", T.DoubleType()), ("max_error_px", T.DoubleType()), ("num_corners", T.LongType()), ("error_message", T.StringType()),
)])


def _now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def _log(spark: SparkSession, folder: str, seq: int, at: str, **values) -> None:
    row = spark.createDataFrame([tuple((values | {"seq": seq}).get(f.name) for f in LOG)], LOG)
    row.withColumn(at, _now()).write.mode("append").parquet(f"{folder}/runs")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A row a run of the log in folder; success is null for one that has not ended."""
    log = spark.read.schema(LOG).parquet(f"{folder}/runs") if _exists(spark, f"{folder}/runs") else spark.createDataFrame([], LOG)
    return catalog.fold_runs(log)


def run_adjustment(observations: DataFrame, camera_poses: DataFrame, marker_poses: DataFrame, cameras: DataFrame, size: float, anchor: int, folder: str, config: adjust.Config = adjust.Config()) -> int:
    """Adjust the map and keep the run in folder: camera_poses, marker_poses and errors by run_id, and the log runs. Returns the run's id, one more than the last.

    The run is logged when it starts and when it ends. One that fails is logged
    with its error, which is raised again, and leaves no tables; earlier runs'
    files are not touched.
    """
    spark = observations.sparkSession
    last = read_runs(spark, folder).agg(F.max("run_id")).first()[0]
    run_id = 1 if last is None else last + 1
    _log(spark, folder, 0, "started_at", run_id=run_id)
    try:
        done = adjust.robust_adjust(observations, camera_poses, marker_poses, cameras, size, anchor, config)
        statistics = adjust.residual_statistics(done.errors).first().asDict()
        for name, table in (("camera_poses", done.camera_poses), ("marker_poses", done.marker_poses), ("errors", done.errors)):
            write_run(table, f"{folder}/{name}", run_id)
    except Exception as e:
        _log(spark, folder, 1, "completed_at", run_id=run_id, success=False, error_message=str(e))
        raise
    _log(spark, folder, 1, "completed_at", run_id=run_id, success=True, **{k: v for k, v in (done.summary | statistics).items() if k in LOG.names})
    return run_id
