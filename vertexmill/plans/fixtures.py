"""Views of the test tables with the shapes of the jobs' inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexmill.functions import geometry as g

#: SQL of each view over the test tables; Spark and DuckDB both run it.
VIEWS = {
    "fx_images": """
SELECT o_orderkey AS image_id,
       concat(CASE WHEN o_orderkey % 2 = 0 THEN 'IMG_' ELSE 'img_' END, CAST(o_orderkey AS STRING), '.png') AS rel_path,
       CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CAST(o_custkey * 1000 AS BIGINT) AS mtime_ms,
       (o_orderstatus = 'P') AS ignored, (o_orderkey % 50 = 0) AS missing,
       CASE o_orderkey % 4 WHEN 0 THEN 'not_run' WHEN 1 THEN 'detected' WHEN 2 THEN 'no_markers' ELSE 'stale' END AS detection_status,
       (o_orderkey % 8 = 5) AS modified_since_detection
FROM orders""",
    "fx_scan": """
SELECT rel_path, size_bytes + CASE WHEN image_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes, mtime_ms FROM fx_images WHERE image_id % 11 <> 0
UNION ALL
SELECT concat('new_', rel_path) AS rel_path, size_bytes, mtime_ms FROM fx_images WHERE image_id % 101 = 0""",
    "fx_detections": """
SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS detection_id, l_orderkey AS image_id, l_suppkey AS marker_id
FROM lineitem""",
    "fx_edges": """
SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS obs_id, l_orderkey AS image_id,
       CAST(floor(l_orderkey / 16e0) AS BIGINT) * 8 + l_linenumber AS marker_id,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_extendedprice / 1e4, 6) + l_suppkey / 1e9 END AS err
FROM lineitem""",
    "fx_errors": """
SELECT l_orderkey AS image_id, l_suppkey AS marker_id, l_linenumber % 4 AS corner, l_quantity / 5e0 AS error_px
FROM lineitem""",
    "fx_runs": """
SELECT event_id AS run_id, user_id AS project_id, ts AS started_at, (event_type <> 'error') AS success,
       value AS mean_error_px, event_type AS setting_key, props AS setting_json
FROM events""",
    "fx_poses": """
SELECT c_custkey AS image_id,
       CASE c_custkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 8e-1 WHEN 2 THEN 6e-1 ELSE 0e0 END AS cos_y,
       CASE c_custkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 6e-1 WHEN 2 THEN 8e-1 ELSE 1e0 END AS sin_y,
       (c_custkey % 37) / 1e1 AS tx, (c_custkey % 23) / 1e1 AS ty, (c_custkey % 11) / 1e1 AS tz
FROM customer""",
    "fx_pose_markers": """
SELECT image_id, image_id % 5 AS marker_id FROM fx_poses
UNION SELECT image_id, 10 + image_id % 3 AS marker_id FROM fx_poses""",
    "fx_path": """
SELECT image_id, cos_y, sin_y, tx + 2e1 * floor(image_id / 4e2) AS tx, ty, tz, CAST(floor(image_id / 4e2) AS BIGINT) AS room FROM fx_poses""",
    "fx_path_markers": """
SELECT image_id, room * 20 + image_id % 5 AS marker_id FROM fx_path
UNION SELECT image_id, room * 20 + 10 + image_id % 3 AS marker_id FROM fx_path""",
    "fx_features": """
SELECT label AS image_id, vec_id AS feature_idx, embedding AS descriptor FROM embeddings""",
    "fx_matches": """
SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS match_id,
       (l_suppkey % 200) * 1000 + 200 + l_orderkey % 190 AS pair_id,
       l_suppkey % 200 AS image_id_a, l_partkey * 10000 + CAST(floor(l_orderkey / 64e0) AS BIGINT) AS feature_idx_a,
       200 + l_orderkey % 190 AS image_id_b, l_orderkey AS feature_idx_b,
       3.2e2 + (l_partkey * 13) % 201 - 100 AS x_a, 2.4e2 + (l_partkey * 7) % 151 - 75 AS y_a,
       3.2e2 + (l_orderkey * 11) % 201 - 100 AS x_b, 2.4e2 + (l_orderkey * 5) % 151 - 75 AS y_b
FROM lineitem""",
    "fx_points": """
SELECT p_partkey AS point_id, p_partkey AS track_id, (p_partkey % 97) / 5e1 AS x, (p_partkey * 7 % 89) / 5e1 AS y, p_size / 2.5e1 AS z,
       2 + p_partkey % 5 AS num_observations, round(p_retailprice / 1e3, 6) AS mean_err, round(p_retailprice / 5e2, 6) AS max_err
FROM part""",
}
TABLES = ("orders", "lineitem", "events", "customer", "embeddings", "part")
CAMERA = {"camera_id": "c", "model": "pinhole_radtan", "image_width": 640, "image_height": 480, "fx": 500.0, "fy": 500.0, "cx": 320.0, "cy": 240.0, "xi": None, "k1": 0.0, "k2": 0.0, "p1": 0.0, "p2": 0.0, "k3": 0.0}
DISTORTED = {"camera_id": "d", "k1": -0.2, "k2": 0.05, "p1": 0.001, "p2": -0.0005}
OMNI = {"camera_id": "o", "model": "omni_radtan", "xi": 0.9}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows over the tables in sf_dir."""
    needed = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in VIEWS[name]}
    needed |= {v: view(spark, sf_dir, v) for v in VIEWS if v != name and v in VIEWS[name].split()}
    return spark.sql(_braced(VIEWS[name], needed), **needed)


def _braced(sql: str, names) -> str:
    """sql with the names of DataFrames in braces."""
    return re.sub(r"\b(" + "|".join(names) + r")\b(?!\.)", r"{\1}", sql)


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names in front."""
    wanted, found = [sql], []
    while wanted:
        text = wanted.pop()
        for v in VIEWS:
            if v in text and v not in found:
                found.append(v)
                wanted.append(VIEWS[v])
    parts = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in found]
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    body = sql.strip()
    if body.startswith("WITH RECURSIVE"):
        return head + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.startswith("WITH"):
        return head + ",\n".join(parts) + ",\n" + body[len("WITH"):]
    return head + ",\n".join(parts) + "\n" + body


def rounded(value):
    """value to six digits as DuckDB's round() has it: the double product by 1e6 is rounded, half away from zero; F.round(value, 6) rounds the shortest decimal, which differs next to ties."""
    return F.round(value * 1e6, 0) / 1e6


def poses(spark: SparkSession, sf_dir: str, name: str = "fx_poses") -> DataFrame:
    """fx_poses, or another view of its columns, as (image_id, T, camera_id)."""
    T = g.pose(g.rotation_y(F.col("cos_y"), F.col("sin_y")), F.array("tx", "ty", "tz"))
    return view(spark, sf_dir, name).select("image_id", T.alias("T"), F.lit("c").alias("camera_id"))


def camera(spark: SparkSession) -> DataFrame:
    return cameras(spark).filter("camera_id = 'c'")


def cameras(spark: SparkSession) -> DataFrame:
    """Three cameras: without distortion, with it, and one that sees all around."""
    from vertexmill.schemas import CAMERAS

    rows = [CAMERA, CAMERA | DISTORTED, CAMERA | DISTORTED | OMNI]
    return spark.createDataFrame([tuple(c[n] for n in CAMERAS.names) for c in rows], CAMERAS)


def cameras_sql() -> str:
    """The cameras for DuckDB, as a subquery with the column is_omni."""
    names = ("fx", "fy", "cx", "cy", "xi", "k1", "k2", "p1", "p2", "k3")
    rows = [(c["camera_id"], c["model"] == "omni_radtan", *[c[n] or 0.0 for n in names]) for c in (CAMERA, CAMERA | DISTORTED, CAMERA | DISTORTED | OMNI)]
    values = ", ".join(f"('{i}', {str(o).lower()}, {', '.join(f'{x:e}' for x in rest)})" for i, o, *rest in rows)
    return f"(SELECT * FROM (VALUES {values}) AS t(camera_id, is_omni, {', '.join(names)}))"
