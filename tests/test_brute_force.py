"""Operators without SQL against plain Python or known truth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import geometry as g
from vertexmill.operators import epipolar, points, poses, tracks
from vertexmill.plans import fixtures as fx
from vertexmill.sources import writers


def greedy(edges, images):
    """Groups of nodes, edges taken in order unless the groups share an image."""
    group = {n: n for e in edges for n in e}
    for u, v in edges:
        a, b = group[u], group[v]
        held = lambda r: [images[n] for n in group if group[n] == r and n in images]
        if a != b and not set(held(a)) & set(held(b)):
            group = {n: (min(a, b) if r in (a, b) else r) for n, r in group.items()}
    roots = {}
    for n, r in group.items():
        roots.setdefault(r, []).append(n)
    return {n: min(m) for m in roots.values() for n in m}


def test_build_tracks(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        a, b = rng.sample(range(5), 2)
        fa, fb = rng.randrange(6), rng.randrange(6)
        rows.append((a * 10 + b, k, a, fa, float(fa), 1.0, b, fb, float(fb), 2.0))
    m = spark.createDataFrame(rows, "pair_id long, match_id long, image_id_a long, feature_idx_a long, x_a double, y_a double, image_id_b long, feature_idx_b long, x_b double, y_b double").repartition(3)
    node = lambda i, f: (i << 32) | f
    edges = [(node(r[2], r[3]), node(r[6], r[7])) for r in sorted(rows)]
    first = {}
    for e in edges:
        first.setdefault(tuple(sorted(e)), e)
    root = greedy(list(first.values()), {n: n >> 32 for e in edges for n in e})
    sizes = {r: list(root.values()).count(r) for r in root.values()}
    want = {(r, n >> 32, n & 0xFFFFFFFF) for n, r in root.items() if sizes[r] > 1}
    assert {(r.track_id, r.image_id, r.feature_idx) for r in tracks.build_tracks(m).collect()} == want


def test_merge_groups(spark):
    rng = np.random.default_rng(1)
    at = rng.uniform(0, 0.2, (40, 3))
    rows = [(i, i, *map(float, p), 1.0 if i % 9 else 5.0, None) for i, p in enumerate(at)]
    p = spark.createDataFrame(rows, "point_id long, track_id long, x double, y double, z double, mean_reprojection_error_px double, max_reprojection_error_px double")
    seen = spark.createDataFrame([(i, i % 4) for i in range(40)], "track_id long, image_id long")
    near = [(i, j) for i in range(40) for j in range(i + 1, 40) if np.linalg.norm(at[i] - at[j]) <= 0.05 and i % 9 and j % 9]
    want = {i: i for i in range(40)} | greedy(near, {i: i % 4 for i in range(40)})
    assert {r.point_id: r.root for r in points.merge_groups(p, seen, 0.05).collect()} == want and len(near) > 10


def scene(spark, model):
    """Marker poses in camera frames and their corners' pixels, by one of the three cameras."""
    rng = np.random.default_rng(2)
    camera = fx.cameras(spark).filter(F.col("camera_id") == model)
    row = camera.first()
    values = np.array([float(row["model"] == "omni_radtan"), *[row[n] or 0.0 for n in arrays.CAMERA[1:]]])
    R, t = arrays.rotations(rng.normal(0, 0.3, (30, 3))), np.stack([*rng.uniform(-0.3, 0.3, (2, 30)), rng.uniform(1, 3, 30)], 1)
    corners = np.einsum("nij,kj->nki", R, arrays.DETECTOR_CORNERS * 0.2) + t[:, None]
    return camera, values, R, t, corners, arrays.project(corners, values)


@pytest.mark.parametrize("model", ["c", "d", "o"])
def test_estimate_poses(spark, model):
    camera, values, R, t, corners, pixels = scene(spark, model)
    rays = arrays.unproject(pixels, values)
    assert np.abs(rays - corners / np.linalg.norm(corners, axis=-1, keepdims=True)).max() < 1e-6
    rows = [(i, i, 0, model, [tuple(map(float, p)) for p in x]) for i, x in enumerate(pixels)] + [(99, 0, 0, model, [(1.0, 1.0)]), (98, 0, 0, model, None)]
    d = spark.createDataFrame(rows, "detection_id long, image_id long, marker_id long, camera_id string, corners array<struct<u:double,v:double>>")
    got = {r.detection_id: r for r in poses.estimate_marker_poses(d, camera, 0.2).collect()}
    assert not got[99].success and not got[98].success and got[99].error_message
    for i in range(30):
        assert got[i].success and got[i].reprojection_error_px < 1e-3 and np.abs(np.array(got[i].T_C_M.t) - t[i]).max() < 1e-3


def test_refine_points(spark):
    rng = np.random.default_rng(4)
    truth = rng.uniform([-0.5, -0.5, 4], [0.5, 0.5, 6], (25, 3))
    centres = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [-1, 0.5, 0.2]])
    c = fx.CAMERA
    obs = [(i, k, float(c["fx"] * (p - at)[0] / (p - at)[2] + c["cx"]), float(c["fy"] * (p - at)[1] / (p - at)[2] + c["cy"])) for i, p in enumerate(truth) for k, at in enumerate(centres)]
    observations = spark.createDataFrame(obs, "track_id long, image_id long, x double, y double")
    at = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(centres)], "image_id long, x double, y double, z double")
    P = at.select("image_id", g.pose(g.rotation_y(F.lit(1.0), F.lit(0.0)), g.vector(F.col("x"), F.col("y"), F.col("z"))).alias("T"), F.lit("c").alias("camera_id"))
    start = spark.createDataFrame([(i, i, *map(float, p + rng.normal(0, 0.03, 3)), True) for i, p in enumerate(truth)], "point_id long, track_id long, x double, y double, z double, is_active boolean")
    for r in points.refine_points(start, observations, P, fx.camera(spark)).collect():
        assert np.abs(np.array([r.x, r.y, r.z]) - truth[r.point_id]).max() < 1e-5 and r.final_cost < 1e-6 < r.initial_cost
    found = {r.track_id: (r.x, r.y, r.z) for r in tracks.triangulate(observations, P, fx.camera(spark)).collect()}
    assert len(found) == 25 and all(np.abs(np.array(found[i]) - truth[i]).max() < 1e-6 for i in found)
    # a pixel far off, an image twice and an image without pose leave the track out
    bad = observations.withColumn("x", F.when((F.col("track_id") == 0) & (F.col("image_id") == 0), F.col("x") + 100).otherwise(F.col("x")))
    bad = bad.union(bad.filter("track_id = 1 and image_id = 2")).union(bad.filter("track_id = 2 and image_id = 2").withColumn("image_id", F.lit(77).cast("long")))
    assert {r.track_id for r in tracks.triangulate(bad, P, fx.camera(spark)).collect()} == set(range(3, 25))


def test_epipolar_errors(spark):
    """Consistent rays have no error, a bad one has; with a null-free but empty table there is no row."""
    rows = [(0, 0, 1, 320.0 + 500 * 0.2 / 5, 240.0 + 500 * 0.1 / 5, 320.0 + 500 * -0.8 / 5, 240.0 + 500 * 0.1 / 5), (1, 0, 1, 340.0, 250.0, 240.0, 290.0)]
    m = spark.createDataFrame(rows, "match_id long, image_id_a long, image_id_b long, x_a double, y_a double, x_b double, y_b double")
    P = spark.createDataFrame([(0, 0.0), (1, 1.0)], "image_id long, x double").select("image_id", g.pose(g.rotation_y(F.lit(1.0), F.lit(0.0)), g.vector(F.col("x"), 0, 0)).alias("T"), F.lit("c").alias("camera_id"))
    located = epipolar.match_geometry(m, P, fx.camera(spark))
    for kind in ("ray_angular", "sampson", "no such"):
        by = {r.match_id: r for r in epipolar.with_epipolar_error(located, kind).collect()}
        assert by[0].epipolar_error < 1e-10 and by[0].is_epipolar_inlier and by[1].epipolar_error > 1e-3 and not by[1].is_epipolar_inlier
    p = {r.match_id: r for r in epipolar.triangulate_pairs(located).collect()}
    assert np.abs(np.array([p[0].x, p[0].y, p[0].z]) - [0.2, 0.1, 5]).max() < 1e-6 and p[0].is_valid and not p[1].is_valid
    assert epipolar.with_epipolar_error(epipolar.match_geometry(m.limit(0), P, fx.camera(spark))).count() == 0


def test_map_file(spark, tmp_path):
    """Six decimals of the exact numbers, ties to even."""
    at = [0.0000005, 1.0000005, 0.5, 2.5]
    p = spark.createDataFrame([(0, *at[:3])], "marker_id long, x double, y double, z double").select("marker_id", g.pose(g.rotation_y(F.lit(1.0), F.lit(0.0)), g.vector(F.col("x"), F.col("y"), F.col("z"))).alias("T"))
    writers.export_marker_map(p, 2.0, str(tmp_path / "map"))
    lines = [x for f in (tmp_path / "map").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == ["id,x,y,z", *[f"{k},{x:.6f},{y:.6f},{0.5:.6f}" for k, (x, y) in enumerate([(at[0] - 1, at[1] - 1), (at[0] - 1, at[1] + 1), (at[0] + 1, at[1] + 1), (at[0] + 1, at[1] - 1)])]]
