"""Checkpoints in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and the master is local, as in tests. Elsewhere a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (named or context.master.startswith("local[") or context.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the checkpoint folder and read it again."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a result of written() that nothing will read again; others are left alone."""
    path = getattr(df, "written_to", None) if df is not None else None
    if path:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
