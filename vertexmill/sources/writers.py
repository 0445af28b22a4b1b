"""Writers: the marker map and the point cloud, as CSV."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexmill.functions import geometry as g

MOST_MARKERS = 1 << 30


def explode_corners(poses: DataFrame, size: float, order: str = "export") -> DataFrame:
    """poses(marker_id, T) with a row a corner: (marker_id, corner, x, y, z) in the world frame."""
    at = poses.select("marker_id", "T", F.explode(g.marker_corners(size, order)).alias("c"))
    placed = at.select("marker_id", F.col("c.corner").alias("corner"), g.transform(F.col("T"), F.col("c.point")).alias("p"))
    return placed.select("marker_id", "corner", *[F.col("p")[i].alias(n) for i, n in enumerate("xyz")])


def marker_map(poses: DataFrame, size: float) -> DataFrame:
    """(id, x, y, z): id is four times the marker's plus the corner's place in the order BL, TL, TR, BR. A marker id outside 0 ... 2^30 - 1 fails the job."""
    good = (F.col("marker_id") >= 0) & (F.col("marker_id") < MOST_MARKERS)
    checked = F.when(good, F.col("marker_id")).otherwise(F.raise_error(F.concat(F.lit("marker id out of range: "), F.col("marker_id").cast("string"))).cast("long"))
    return explode_corners(poses, size).select(F.shiftleft(checked, 2).bitwiseOR(F.col("corner")).alias("id"), "x", "y", "z")


@F.pandas_udf(T.StringType())
def _six_decimals(x: pd.Series) -> pd.Series:
    """The number's exact value to six decimals, ties to even."""
    return x.map("{:.6f}".format)


def _six(name: str):
    return _six_decimals(name).alias(name)


def export_marker_map(poses: DataFrame, size: float, path: str) -> None:
    """Write the marker map, in id order, with six decimals; no poses is an error."""
    if poses.isEmpty():
        raise ValueError("there are no marker poses to export")
    marker_map(poses, size).orderBy("id").select("id", *map(_six, "xyz")).write.mode("overwrite").option("header", True).csv(path)


def export_point_cloud(points: DataFrame, path: str) -> None:
    """Write x, y, z of the active points, in id order."""
    points.filter("is_active").orderBy("point_id").select("x", "y", "z").write.mode("overwrite").option("header", True).csv(path)
