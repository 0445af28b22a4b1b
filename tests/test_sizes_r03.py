"""Steps that failed or differed on larger tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from vertexmill.functions import cameras as cam
from vertexmill.functions import matches as mt
from vertexmill.operators import graph, points, tracks
from vertexmill.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_poses_are_not_broadcast(spark, monkeypatch):
    """Their files are small, their rows in the driver's memory are not."""
    seen = fx.view(spark, SF, "fx_points").select("track_id", (F.col("track_id") % 100).alias("image_id"), "x", "y")
    found = []

    class Stop(Exception):
        pass

    def stop(df):
        found.append(plan(df))
        raise Stop

    monkeypatch.setattr(tracks, "written", stop)
    try:
        tracks.triangulate(seen, fx.poses(spark, SF), fx.camera(spark))
    except Stop:
        pass
    p = seen.select("track_id", F.col("track_id").alias("point_id"), "x", "y", F.lit(1.0).alias("z"), F.lit(True).alias("is_active"))
    found.append(plan(points.point_observations(p, seen, fx.poses(spark, SF))))
    for text in found:
        poses = [line for line in text.splitlines() if "image_id" in line and "Join" in line]
        assert poses and not any("Broadcast" in line for line in poses)


def test_radius_pairs_are_shuffled(spark):
    """The copies in the cells around are not broadcast; pairs are those of all against all, copies and cell borders included."""
    at = [(k, (k % 7) / 50, (k % 5) / 50, (k % 3) / 25) for k in range(60)]
    p = spark.createDataFrame(at, "point_id long, x double, y double, z double")
    found = points.radius_pairs(p, 0.045)
    assert "Broadcast" not in plan(found)
    far = {(a[0], b[0]): sum((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)) ** 0.5 for a in at for b in at if a[0] < b[0]}
    got = [(r.i, r.j) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k, d in far.items() if d <= 0.045}


MATCHES = "pair_id long, match_id long, image_id_a long, feature_idx_a long, x_a double, y_a double, image_id_b long, feature_idx_b long, x_b double, y_b double"
WIDE = 1 << 32


def test_first_coordinates_of_ids_of_any_size(spark):
    m = spark.createDataFrame([(0, 1, 0, WIDE + 5, 1.0, 2.0, 1, 5, 3.0, 4.0), (0, 0, 0, WIDE + 5, 7.0, 8.0, 1 << 40, 6, 9.0, 0.0)], MATCHES)
    got = {(r.image_id, r.feature_idx): (r.x, r.y) for r in tracks.first_coordinates(m).collect()}
    assert got == {(0, WIDE + 5): (7.0, 8.0), (1, 5): (3.0, 4.0), (1 << 40, 6): (9.0, 0.0)}


def test_tracks_of_wide_feature_ids(spark):
    """Features beyond 32 bits are features of their own, also beside one of the next image with the same low bits."""
    m = spark.createDataFrame([(0, 0, 0, WIDE + 5, 0.0, 0.0, 3, 1, 0.0, 0.0), (0, 1, 1, 5, 0.0, 0.0, 4, 1, 0.0, 0.0)], MATCHES)
    by = {}
    for r in tracks.build_tracks(m).collect():
        by.setdefault(r.track_id, set()).add((r.image_id, r.feature_idx))
    assert sorted(map(sorted, by.values())) == [[(0, WIDE + 5), (3, 1)], [(1, 5), (4, 1)]]


def test_epipolar_errors_to_the_last_bit():
    """Both errors are those of plain arithmetic in the SQL's order, so that neither limits nor rounding tell them apart."""
    r = np.random.default_rng(3)
    n = 5000
    a, b = np.c_[r.integers(-100, 101, (n, 2)) / 500, np.ones(n)], np.c_[r.integers(-100, 101, (n, 2)) / 500, np.ones(n)]
    t = r.integers(-30, 31, (n, 3)) / 10
    c, s = np.array([(1.0, 0.0), (0.8, 0.6), (0.6, 0.8)])[r.integers(0, 3, n)].T
    R = np.zeros((n, 3, 3))
    R[:, 0, 0], R[:, 0, 2], R[:, 1, 1], R[:, 2, 0], R[:, 2, 2] = c, s, 1, -s, c
    for k, (angular, sampson) in enumerate(zip(mt.ray_angular_error(a, b, R, t), mt.sampson_error(a, b, R, t), strict=True)):
        (ax, ay, _), (bx, by, _), (t1, t2, t3), ck, sk = a[k].tolist(), b[k].tolist(), t[k].tolist(), float(c[k]), float(s[k])
        la, lb = math.sqrt(ax * ax + ay * ay + 1), math.sqrt(bx * bx + by * by + 1)
        w1, w2, w3 = ck * (ax / la) + sk * (1 / la), ay / la, ck * (1 / la) - sk * (ax / la)
        n1, n2, n3 = t2 * w3 - t3 * w2, t3 * w1 - t1 * w3, t1 * w2 - t2 * w1
        size = math.sqrt(n1 * n1 + n2 * n2 + n3 * n3)
        assert angular == (abs(n1 * (bx / lb) + n2 * (by / lb) + n3 * (1 / lb)) / size if size > 1e-12 else math.inf)
        w1, w2, w3 = ck * ax + sk, ay, ck - sk * ax
        n1, n2, n3 = t2 * w3 - t3 * w2, t3 * w1 - t1 * w3, t1 * w2 - t2 * w1
        u1, u2, u3 = by * t3 - t2, t1 - bx * t3, bx * t2 - by * t1
        m1, m2 = ck * u1 - sk * u3, u2
        scale, value = n1 * n1 + n2 * n2 + m1 * m1 + m2 * m2, bx * n1 + by * n2 + n3
        assert sampson == (value * value / scale if scale > 1e-12 else math.inf)


def test_images_of_equal_markers_are_not_paired_by_a_shuffle(spark, monkeypatch):
    """Counts as of all against all, over blocks of three images; what is grouped are classes, not images."""
    monkeypatch.setattr(graph, "BLOCK_ROWS", 3)
    rows = [(i, m) for i in range(40) for m in ({i % 2, 10 + i % 3} if i < 36 else {i})] + [(0, 0)]
    got = graph.common_markers(spark.createDataFrame(rows, "image_id long, marker_id long"))
    by = {i: {m for j, m in rows if j == i} for i in range(40)}
    want = sorted((a, b, len(by[a] & by[b])) for a in by for b in by if a < b and by[a] & by[b])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Aggregate" not in plan(got)


def test_pixels_are_unprojected_as_arrays(spark):
    """Rays are those of the columns, null where they are; and the plan works on batches."""
    rows = [(k, "cdox"[k % 4], None if k % 11 == 5 else {"u": 10.0 * k, "v": 400.0 - 7 * k}) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, camera_id string, pixel struct<u:double,v:double>")
    cameras = fx.cameras(spark)
    cameras = cameras.union(cameras.filter("camera_id = 'c'").withColumns({"camera_id": F.lit("x"), "model": F.lit("fisheye")}))
    found = cam.unproject(df, cameras)
    assert "MapInArrow" in plan(found) and found.columns == ["id", "camera_id", "pixel", "ray"]
    want = {r.id: r.ray for r in cam.with_camera(df, cameras).withColumn("ray", cam.unproject_column(F.col("pixel"), F.col("camera"))).collect()}
    got = {r.id: r.ray for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 60
    for k, ray in want.items():
        assert (got[k] is None) == (ray is None) and (ray is None or np.allclose(got[k], ray, rtol=0, atol=1e-14))
