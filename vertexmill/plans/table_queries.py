"""Queries of the operators that keep tables: ingest, work-lists, replacement, listings, poses and checks; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexmill.functions import cameras as cam
from vertexmill.functions import geometry as g
from vertexmill.operators import catalog, epipolar, graph, matching, poses, run_tables, tracks
from vertexmill.plans.checkpoints import checkpoint_dir
from vertexmill.sources import readers, writers

from . import fixtures as fx


def r6(*names: str):
    return [F.round(F.col(n) + 0.0, 6).alias(n) for n in names]


def read_detections(spark, d):
    """Corners as JSON text; every seventh has three corners."""
    text = F.concat(F.lit("[[1.5,2.5],[3,4],[5,6]"), F.when(F.col("detection_id") % 7 > 0, F.concat(F.lit(",["), F.col("marker_id").cast("string"), F.lit(",0.25]"))).otherwise(""), F.lit("]"))
    read = readers.read_detections(fx.view(spark, d, "fx_detections").withColumn("corners_json", text))
    return read.select("detection_id", "image_id", F.coalesce(F.size("corners"), F.lit(0)).alias("num_corners"), F.col("corners")[3]["u"].alias("last_u"), F.col("corners")[0]["v"].alias("first_v"), "reason")


def read_features(spark, d):
    """Each image's record of arrays back to a row a keypoint."""
    f = fx.view(spark, d, "fx_features").select("image_id", "feature_idx", F.transform("descriptor", lambda x: x.cast("double")).alias("descriptor"))
    rows = F.sort_array(F.collect_list(F.struct("feature_idx", "descriptor")))
    records = f.groupBy("image_id").agg(rows.alias("r")).select("image_id", F.transform("r", lambda x: F.array(x["feature_idx"].cast("double"), x["feature_idx"] / 2.0)).alias("keypoints"), F.col("r.descriptor").alias("descriptors"), F.lit(None).cast("array<double>").alias("scores"))
    return readers.read_features(records).select("image_id", "feature_idx", "x", "y", "score", *[F.round(F.col("descriptor")[0], 6).alias("d0")])


def marker_families(spark, d):
    rows = fx.view(spark, d, "fx_detections").select("detection_id", F.when(F.col("marker_id") % 3 == 0, F.lit("DICT_APRILTAG_36h11")).otherwise("DICT_4X4_50").alias("dictionary"), F.when(F.col("marker_id") % 5 == 0, F.lit("AprilTag")).otherwise("aruco").alias("detector"))
    return rows.select("detection_id", readers.marker_family(F.col("dictionary"), F.col("detector")).alias("marker_family"))


def image_order(spark, d):
    """Each image's predecessor in the order of the listing, within the orders of one price."""
    from pyspark.sql import Window

    images = fx.view(spark, d, "fx_images")
    order = Window.partitionBy(F.col("mtime_ms")).orderBy(catalog.path_order(), "image_id")
    return images.select("image_id", F.lag("rel_path").over(order).alias("before"))


def snapshot(spark, d):
    new = fx.view(spark, d, "fx_runs").select("run_id", "project_id", F.when(F.col("success"), F.lit("2020-01-01T00:00:00+00:00")).alias("created_at"))
    return catalog.snapshot(new, F.lit("2024-05-06T07:08:09+00:00"))


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/kept-{uuid.uuid4()}"


def run_table(spark, d):
    """A table kept by run, in files: run 3 is replaced, and read with the latest successful one."""
    rows = fx.view(spark, d, "fx_runs").select((F.col("project_id") % 8).alias("run_id"), F.col("run_id").alias("row_id"), "mean_error_px", "success")
    schema, path = T.StructType([f for f in rows.schema if f.name != "run_id"]), _folder(spark)
    rows.write.partitionBy("run_id").parquet(path)
    run_tables.write_run(rows.filter("run_id = 3 and success").withColumn("mean_error_px", F.col("mean_error_px") + 1).drop("run_id"), path, 3)
    runs = rows.groupBy("run_id").agg((F.col("run_id") < 7).alias("success"))
    both = run_tables.read_run(spark, path, schema, runs).union(run_tables.read_run(spark, path, schema, runs, 3))
    return both.select("run_id", "row_id", *r6("mean_error_px"), "success")


def file_generations(spark, d):
    """Files from before and after two columns came, read as one table."""
    rows, path = fx.view(spark, d, "fx_runs"), _folder(spark)
    rows.filter("run_id % 3 = 0").select("run_id").write.parquet(path)
    rows.filter("run_id % 3 > 0").select("run_id", F.col("setting_key").alias("extraction_mode"), "mean_error_px").write.mode("append").parquet(path)
    schema = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("extraction_mode", T.StringType()), T.StructField("mean_error_px", T.DoubleType())])
    return run_tables.read_generations(spark, path, schema, ("extraction_mode",), {"mean_error_px": -1.0}).select("run_id", "extraction_mode", *r6("mean_error_px"))


def point_file(spark, d):
    """The point cloud's file, read back."""
    path = _folder(spark)
    writers.export_point_cloud(fx.view(spark, d, "fx_points").withColumn("is_active", F.col("z") > 1), path)
    return spark.read.schema("x double, y double, z double").option("header", True).csv(path).select(*r6("x", "y", "z"))


def evolve_table(spark, d):
    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("extraction_mode", T.StringType()), T.StructField("sharpness", T.DoubleType())])
    old = fx.view(spark, d, "fx_images").select("image_id", F.when(F.col("ignored"), "fast").alias("extraction_mode"), "rel_path")
    return catalog.evolve(old, schema, ("extraction_mode",))


def _feature_records(spark, d):
    i = F.col("image_id")
    return fx.view(spark, d, "fx_images").filter(i % 3 > 0).select("image_id", F.when(i % 5 > 0, "success").otherwise("failed").alias("status"), F.when(i % 7 > 0, "fast").otherwise("slow").alias("extraction_mode"), F.when(i % 11 > 0, "own").alias("descriptor_source"))


def pending_images(spark, d):
    return catalog.pending_images(fx.view(spark, d, "fx_images"), _feature_records(spark, d), "fast", "own").select("image_id", "rel_path")


def _pairs(spark, d):
    m = fx.view(spark, d, "fx_matches").groupBy("image_id_a", "image_id_b", "pair_id").agg(F.count("*").alias("n"))
    return m.select("pair_id", "image_id_a", "image_id_b", F.when(F.col("n") % 3 > 0, F.col("n")).alias("num_raw_matches"), F.lit("candidate").alias("status"), F.lit(7).cast("long").alias("num_epipolar_inliers"))


def pending_pairs(spark, d):
    return catalog.pending_pairs(_pairs(spark, d), most=1000).select("image_id_a", "image_id_b")


def _replaced(spark, d):
    old = fx.view(spark, d, "fx_matches").select("pair_id", "match_id")
    done = _pairs(spark, d).filter("pair_id % 4 = 0")
    new = old.filter("pair_id % 8 = 0 and match_id % 3 = 0")
    return catalog.replace_matches(_pairs(spark, d), old, new, done)


def replace_matches(spark, d):
    return _replaced(spark, d)[1]


def replace_match_counts(spark, d):
    return _replaced(spark, d)[0].select("pair_id", "status", F.coalesce("num_raw_matches", F.lit(-1)).alias("num_raw_matches"), "num_epipolar_inliers")


def _old_points(spark, d):
    return fx.view(spark, d, "fx_points").select("point_id", "x", "y", "z", F.when(F.col("point_id") % 3 > 0, "triangulated").otherwise("merged").alias("source"), F.lit(True).alias("is_active"))


def replace_triangulated(spark, d):
    new = _old_points(spark, d).filter("point_id % 5 = 0").withColumn("source", F.lit("triangulated"))
    return catalog.replace_triangulated(_old_points(spark, d), new).select("point_id", "source")


def activate_points(spark, d):
    new = _old_points(spark, d).filter("point_id % 5 = 0").withColumn("point_id", F.col("point_id") + 1_000_000)
    return catalog.activate(_old_points(spark, d), new).select("point_id", "source", "is_active")


def move_points(spark, d):
    refined = _old_points(spark, d).filter("point_id % 2 = 0").select("point_id", (F.col("x") + 1).alias("x"), (F.col("y") - 1).alias("y"), "z")
    return catalog.move_points(_old_points(spark, d), refined).select("point_id", *r6("x", "y", "z"), "source")


def replace_run(spark, d):
    errors = fx.view(spark, d, "fx_errors").withColumn("run_id", F.col("image_id") % 4)
    return catalog.replace_run(errors, errors.filter("corner = 0").drop("run_id"), 2).select("run_id", "image_id", "marker_id", "corner", *r6("error_px"))


def match_listing(spark, d):
    """The matches of one image's pairs."""
    return catalog.listing(fx.view(spark, d, "fx_matches"), "matches", image_id_a=3).select("pair_id", "match_id")


def redetected_rows(spark, d):
    old, images = fx.view(spark, d, "fx_detections"), fx.view(spark, d, "fx_images")
    keys = images.filter("modified_since_detection").select("image_id")
    return catalog.replace_detections(images, old, old.join(keys, "image_id", "left_semi").filter("marker_id >= 50"), keys)[1]


def update_pairs(spark, d):
    pairs = _pairs(spark, d)
    results = pairs.filter("pair_id % 3 = 0").select("image_id_a", "image_id_b", (F.col("pair_id") % 20).alias("num_epipolar_inliers"), F.lit("filtered").alias("status"))
    return epipolar.update_pairs(pairs, results).select("pair_id", "status", "num_epipolar_inliers")


def pose_summary(spark, d):
    edges = fx.view(spark, d, "fx_edges").select(F.col("err").isNotNull().alias("success"), F.col("err").alias("reprojection_error_px"))
    return poses.pose_summary(edges).select("total", "succeeded", "failed", *r6("mean_error_px"))


def overlap_images(spark, d):
    """Overlaps with the images that show them, over the edges."""
    o = graph.marker_overlaps(fx.view(spark, d, "fx_edges"))
    return o.select("marker_a", "marker_b", "num_images", F.concat_ws(" ", F.transform("image_ids", lambda x: x.cast("string"))).alias("images"))


def fall_back(spark, d):
    """No camera was optimised, so the seeds count."""
    seeds = fx.view(spark, d, "fx_poses").select("image_id", "tx")
    return graph.fall_back(seeds.filter("image_id < 0"), seeds).select("image_id", *r6("tx"))


def unseeded_markers(spark, d):
    return graph.without(fx.view(spark, d, "fx_detections"), fx.view(spark, d, "fx_pose_markers"), "marker_id")


def first_coordinates(spark, d):
    return tracks.first_coordinates(fx.view(spark, d, "fx_matches")).select("image_id", "feature_idx", *r6("x", "y"))


def camera_checks(spark, d):
    """Camera rows with one fault or none."""
    i = F.col("image_id")
    rows = fx.view(spark, d, "fx_poses").select(
        i.cast("string").alias("camera_id"), F.when(i % 9 == 1, "fisheye").when(i % 9 != 2, "pinhole_radtan").alias("model"), F.when(i % 9 != 3, 640).alias("image_width"), F.when(i % 9 == 4, 0).otherwise(480).alias("image_height"),
        F.when(i % 9 == 5, -1.0).otherwise(500.0).alias("fx"), F.when(i % 9 != 6, 500.0).alias("fy"), *[F.lit(0.0).alias(c) for c in ("cx", "cy", "xi", "k1", "k2", "p1", "p2", "k3")],
    )
    good, bad = cam.check_cameras(rows)
    return good.select("camera_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("camera_id", "reason"))


def in_image(spark, d):
    m = fx.view(spark, d, "fx_matches")
    u = F.when(F.col("match_id") % 13 == 0, float("nan")).otherwise(F.col("x_a"))
    return m.select("match_id", cam.in_image(F.struct(u.alias("u"), F.col("y_a").alias("v")), F.lit(400), F.lit(300)).alias("inside"))


def unit_vectors(spark, d):
    v = F.when(F.col("image_id") % 10 == 0, g.vector(0, 0, 0)).when(F.col("image_id") % 10 != 1, F.array("tx", "ty", "tz"))
    rows = fx.view(spark, d, "fx_poses").select("image_id", v.alias("v"))
    return rows.select("image_id", *[F.round(g.unit(F.col("v"))[i] + 0.0, 6).alias(n) for i, n in enumerate("xyz")], g.unit_reason(F.col("v")).alias("reason"))


def pose_vectors(spark, d):
    """Poses to six numbers and back."""
    p = fx.poses(spark, d).withColumn("x", g.to_vector(F.col("T"))).withColumn("back", g.from_vector(F.col("x")))
    return p.select("image_id", *[F.round(F.col("x")[i] + 0.0, 6).alias(f"x{i}") for i in range(6)], F.round(F.col("back.R")[0][2] + 0.0, 6).alias("r02"), F.round(F.col("back.R")[2][2] + 0.0, 6).alias("r22"))


def pose_json(spark, d):
    """Poses to JSON and back; every fifth text lacks a number."""
    text = F.when(F.col("image_id") % 5 > 0, g.to_json(F.col("T"))).otherwise(F.lit('{"R":[[1,0,0],[0,1,0],[0,0,1]],"t":[1,2]}'))
    return fx.poses(spark, d).withColumn("P", g.from_json(text)).select("image_id", F.round(F.col("P.t")[0], 6).alias("tx"), F.round(F.col("P.R")[0][2] + 0.0, 6).alias("r02"))


def feature_checks(spark, d):
    """Records with one fault or none."""
    i = F.col("image_id")
    key, far = F.array(F.array(F.lit(1.0), F.lit(2.0))), F.array(F.array(F.lit(0.5), F.lit(0.5)))
    records = fx.view(spark, d, "fx_images").select(
        "image_id", F.when(i % 9 == 1, "failed").otherwise("success").alias("status"), F.when(i % 9 != 2, "fast").alias("extraction_mode"), F.lit("own").alias("descriptor_source"), F.when(i % 9 == 3, 0).otherwise(1).alias("num_keypoints"),
        F.when(i % 9 == 4, F.array(F.array(F.lit(1.0)))).when(i % 9 != 5, key).alias("keypoints"), F.when(i % 9 == 6, F.concat(far, far)).otherwise(far).alias("descriptors"), F.when(i % 9 == 7, F.array(F.lit(1.0), F.lit(2.0))).alias("scores"),
    )
    good, bad = matching.check_features(records, "fast", "own")
    return good.select("image_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("image_id", "reason"))


QUERIES = {f.__name__: f for f in (
    read_detections, read_features, marker_families, image_order, snapshot, run_table, file_generations, point_file, evolve_table, pending_images, pending_pairs, replace_matches, replace_match_counts, replace_triangulated, activate_points, move_points, replace_run,
    match_listing, redetected_rows, update_pairs, pose_summary, overlap_images, fall_back, unseeded_markers, first_coordinates, camera_checks, in_image, unit_vectors, pose_vectors, pose_json, feature_checks,
)}

_PAIRS = "pairs AS (SELECT pair_id, image_id_a, image_id_b, CASE WHEN count(*) % 3 > 0 THEN count(*) END AS num_raw_matches FROM fx_matches GROUP BY 1, 2, 3)"
_POINTS = "pts AS (SELECT point_id, x, y, z, CASE WHEN point_id % 3 > 0 THEN 'triangulated' ELSE 'merged' END AS source FROM fx_points)"

ORACLES = {
    "run_table": """
WITH r AS (SELECT project_id % 8 AS run_id, run_id AS row_id, mean_error_px, success FROM fx_runs)
SELECT run_id, row_id, round(mean_error_px + CASE WHEN run_id = 3 THEN 1e0 ELSE 0e0 END, 6) AS mean_error_px, success FROM r WHERE run_id = (SELECT max(run_id) FROM r WHERE run_id < 7) OR (run_id = 3 AND success)""",
    "file_generations": """
SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'unknown' ELSE coalesce(setting_key, 'unknown') END AS extraction_mode, round(CASE WHEN run_id % 3 = 0 THEN -1e0 ELSE coalesce(mean_error_px, -1e0) END, 6) AS mean_error_px FROM fx_runs""",
    "point_file": "SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM fx_points WHERE z > 1",
    "read_detections": """
SELECT detection_id, image_id, CASE WHEN detection_id % 7 > 0 THEN 4 ELSE 0 END AS num_corners, CASE WHEN detection_id % 7 > 0 THEN CAST(marker_id AS DOUBLE) END AS last_u, CASE WHEN detection_id % 7 > 0 THEN 2.5e0 END AS first_v,
       CASE WHEN detection_id % 7 = 0 THEN 'four corners of two numbers are needed' END AS reason FROM fx_detections""",
    "read_features": """
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY feature_idx) - 1 AS feature_idx, CAST(feature_idx AS DOUBLE) AS x, feature_idx / 2e0 AS y, CAST(NULL AS DOUBLE) AS score, round(CAST(descriptor[1] AS DOUBLE), 6) AS d0 FROM fx_features""",
    "marker_families": "SELECT detection_id, CASE WHEN marker_id % 3 = 0 OR marker_id % 5 = 0 THEN 'apriltag' ELSE 'aruco' END AS marker_family FROM fx_detections",
    "image_order": "SELECT image_id, lag(rel_path) OVER (PARTITION BY mtime_ms ORDER BY lower(rel_path), image_id) AS before FROM fx_images",
    "snapshot": "SELECT run_id, project_id, CASE WHEN success THEN '2020-01-01T00:00:00+00:00' ELSE '2024-05-06T07:08:09+00:00' END AS created_at FROM fx_runs",
    "evolve_table": "SELECT image_id, CASE WHEN ignored THEN 'fast' ELSE 'unknown' END AS extraction_mode, CAST(NULL AS DOUBLE) AS sharpness, rel_path FROM fx_images",
    "pending_images": "SELECT image_id, rel_path FROM fx_images WHERE image_id % 3 = 0 OR image_id % 5 = 0 OR image_id % 7 = 0 OR image_id % 11 = 0",
    "pending_pairs": f"WITH {_PAIRS} SELECT image_id_a, image_id_b FROM pairs WHERE num_raw_matches IS NULL ORDER BY 1, 2 LIMIT 1000",
    "replace_matches": "SELECT pair_id, match_id FROM fx_matches WHERE pair_id % 4 <> 0 OR (pair_id % 8 = 0 AND match_id % 3 = 0)",
    "replace_match_counts": f"""WITH {_PAIRS}, new AS (SELECT pair_id, count(*) AS n FROM fx_matches WHERE pair_id % 8 = 0 AND match_id % 3 = 0 GROUP BY 1)
SELECT pair_id, CASE WHEN pair_id % 4 = 0 THEN 'matched' ELSE 'candidate' END AS status, CASE WHEN pair_id % 4 = 0 THEN coalesce(n, 0) ELSE coalesce(num_raw_matches, -1) END AS num_raw_matches, CAST(CASE WHEN pair_id % 4 = 0 THEN 0 ELSE 7 END AS BIGINT) AS num_epipolar_inliers
FROM pairs LEFT JOIN new USING (pair_id)""",
    "replace_triangulated": f"WITH {_POINTS} SELECT point_id, source FROM pts WHERE source <> 'triangulated' UNION ALL SELECT point_id, 'triangulated' FROM pts WHERE point_id % 5 = 0",
    "activate_points": f"WITH {_POINTS} SELECT point_id, source, false AS is_active FROM pts UNION ALL SELECT point_id + 1000000, 'merged', true FROM pts WHERE point_id % 5 = 0",
    "move_points": f"WITH {_POINTS} SELECT point_id, round(CASE WHEN point_id % 2 = 0 THEN x + 1 ELSE x END, 6) AS x, round(CASE WHEN point_id % 2 = 0 THEN y - 1 ELSE y END, 6) AS y, round(z, 6) AS z, CASE WHEN point_id % 2 = 0 THEN 'dense_ba' ELSE source END AS source FROM pts",
    "replace_run": """
SELECT image_id % 4 AS run_id, image_id, marker_id, corner, round(error_px, 6) AS error_px FROM fx_errors WHERE image_id % 4 <> 2 UNION ALL SELECT 2, image_id, marker_id, corner, round(error_px, 6) FROM fx_errors WHERE corner = 0""",
    "match_listing": "SELECT pair_id, match_id FROM fx_matches WHERE image_id_a = 3 ORDER BY 1, 2",
    "redetected_rows": "SELECT d.* FROM fx_detections d JOIN fx_images i USING (image_id) WHERE NOT modified_since_detection OR marker_id >= 50",
    "update_pairs": f"WITH {_PAIRS} SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 'filtered' ELSE 'candidate' END AS status, CAST(CASE WHEN pair_id % 3 = 0 THEN pair_id % 20 ELSE 7 END AS BIGINT) AS num_epipolar_inliers FROM pairs",
    "pose_summary": "SELECT count(*) AS total, count(err) AS succeeded, count(*) - count(err) AS failed, round(avg(err), 6) AS mean_error_px FROM fx_edges",
    "overlap_images": """
WITH e AS (SELECT DISTINCT image_id, marker_id FROM fx_edges)
SELECT a.marker_id AS marker_a, b.marker_id AS marker_b, count(*) AS num_images, string_agg(a.image_id, ' ' ORDER BY a.image_id) AS images FROM e a JOIN e b ON a.image_id = b.image_id AND a.marker_id < b.marker_id GROUP BY 1, 2""",
    "fall_back": "SELECT image_id, round(tx, 6) AS tx FROM fx_poses",
    "unseeded_markers": "SELECT DISTINCT marker_id FROM fx_detections WHERE marker_id NOT IN (SELECT marker_id FROM fx_pose_markers)",
    "first_coordinates": """
WITH ends AS (SELECT image_id_a AS image_id, feature_idx_a AS feature_idx, x_a AS x, y_a AS y, pair_id, match_id, 0 AS side FROM fx_matches UNION ALL SELECT image_id_b, feature_idx_b, x_b, y_b, pair_id, match_id, 1 FROM fx_matches)
SELECT image_id, feature_idx, round(x, 6) AS x, round(y, 6) AS y FROM ends QUALIFY row_number() OVER (PARTITION BY image_id, feature_idx ORDER BY pair_id, match_id, side) = 1""",
    "camera_checks": """
SELECT CAST(image_id AS VARCHAR) AS camera_id, CASE image_id % 9 WHEN 1 THEN 'unknown camera model: fisheye' WHEN 2 THEN 'missing field: model' WHEN 3 THEN 'missing field: image_width' WHEN 4 THEN 'image_height must be positive' WHEN 5 THEN 'fx must be positive' WHEN 6 THEN 'missing field: fy' END AS reason FROM fx_poses""",
    "in_image": "SELECT match_id, match_id % 13 <> 0 AND x_a >= 0 AND x_a < 400 AND y_a >= 0 AND y_a < 300 AS inside FROM fx_matches",
    "unit_vectors": """
WITH v AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS n, image_id % 10 AS kind FROM fx_poses)
SELECT image_id, CASE WHEN kind > 1 AND n > 1e-12 THEN round(tx / n, 6) END AS x, CASE WHEN kind > 1 AND n > 1e-12 THEN round(ty / n, 6) END AS y, CASE WHEN kind > 1 AND n > 1e-12 THEN round(tz / n, 6) END AS z,
       CASE WHEN kind = 1 THEN 'missing vector' WHEN kind = 0 OR n <= 1e-12 THEN 'near-zero vector' END AS reason FROM v""",
    "pose_vectors": """
SELECT image_id, round(tx, 6) AS x0, round(ty, 6) AS x1, round(tz, 6) AS x2, 0e0 AS x3, round(atan2(sin_y, cos_y), 6) AS x4, 0e0 AS x5, round(sin_y, 6) AS r02, round(cos_y, 6) AS r22 FROM fx_poses""",
    "pose_json": "SELECT image_id, CASE WHEN image_id % 5 > 0 THEN round(tx, 6) END AS tx, CASE WHEN image_id % 5 > 0 THEN round(sin_y, 6) END AS r02 FROM fx_poses",
    "feature_checks": """
SELECT image_id, CASE image_id % 9 WHEN 1 THEN 'extraction did not succeed' WHEN 2 THEN 'incompatible feature format' WHEN 3 THEN 'no keypoints' WHEN 4 THEN 'invalid keypoint shape' WHEN 5 THEN 'missing keypoints or descriptors'
       WHEN 6 THEN 'keypoints and descriptors differ in number' WHEN 7 THEN 'scores and keypoints differ in number' END AS reason FROM fx_images""",
}
