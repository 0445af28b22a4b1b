"""Derivatives in closed form, and a registered camera model in every job that works on arrays."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import cameras as cam
from vertexmill.functions import geometry as g
from vertexmill.functions import losses
from vertexmill.operators import adjust, epipolar, points, poses, tracks
from vertexmill.plans import fixtures as fx
from vertexmill.schemas import CAMERAS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test file
KINDS = {"pinhole": [0, 500, 480, 320, 240, 0, -0.2, 0.05, 0.001, -0.0005, 0.01], "omni": [1, 500, 480, 320, 240, 0.9, -0.2, 0.05, 0.001, -0.0005, 0.01]}


def mirror_project(p, c):
    """A camera that is a pinhole in a mirror, with a stretch k1 of x."""
    seen = p[:, 2] > 1e-9
    z = np.where(seen, p[:, 2], 1.0)
    return np.where(seen[:, None], np.stack([c["cx"] - c["fx"] * (1 + c["k1"]) * p[:, 0] / z, c["cy"] + c["fy"] * p[:, 1] / z], -1), np.nan)


def mirror_unproject(x, c):
    return np.stack([(c["cx"] - x[:, 0]) / c["fx"] / (1 + c["k1"]), (x[:, 1] - c["cy"]) / c["fy"], np.ones(len(x))], -1)


def _column_project(p, c):
    seen = p[2] > 1e-9
    return F.struct(F.when(seen, c("cx") - c("fx") * (1 + c("k1")) * p[0] / p[2]).otherwise(cam.NAN).alias("u"), F.when(seen, c("cy") + c("fy") * p[1] / p[2]).otherwise(cam.NAN).alias("v"))


def _column_unproject(x, c):
    return g.unit(g.vector((c("cx") - x["u"]) / c("fx") / (1 + c("k1")), (x["v"] - c("cy")) / c("fy"), 1))


@pytest.fixture
def mirror(spark):
    """A camera of a registered model."""
    cam.register("mirror", cam.Model(_column_project, _column_unproject, ("fx", "fy", "cx", "cy", "k1"), mirror_project, mirror_unproject))
    row = fx.CAMERA | {"camera_id": "m", "model": "mirror", "k1": 0.1}
    yield spark.createDataFrame([tuple(row[n] for n in CAMERAS.names)], CAMERAS)
    del cam.MODELS["mirror"]


def lens(kind, n):
    if kind == "mirror":
        return arrays.Lenses(np.tile([2.0, *[float(fx.CAMERA[c] or 0) for c in arrays.CAMERA[1:6]], 0.1, 0, 0, 0, 0], (n, 1)), ((mirror_project, mirror_unproject),))
    return np.tile(np.array(KINDS[kind], float), (n, 1))


@pytest.mark.parametrize("kind", ["pinhole", "omni", "mirror"])
def test_derivatives(kind):
    r = np.random.default_rng(1)
    n, corners = 50, arrays.DETECTOR_CORNERS * 0.3
    camera_xi = np.concatenate([r.normal(0, 0.2, (n, 3)), r.normal(0, 0.3, (n, 3))], 1)
    marker_xi = np.concatenate([r.normal(0, 0.4, (n, 2)), r.uniform(2, 4, (n, 1)), r.normal(0, 0.8, (n, 3))], 1)
    camera_xi[0, 3:] = marker_xi[1, 3:] = 0
    camera_xi[2, 3:] = 1e-6
    marker_xi[3, 2] = -3  # behind the camera
    camera, pixels = lens(kind, n), r.uniform(0, 400, (n, 4, 2))
    residual, by_camera, by_marker = adjust._linear(camera_xi, marker_xi, pixels, camera, corners, 1e6)
    assert np.array_equal(residual, adjust._residuals(camera_xi, marker_xi, pixels, camera, corners, 1e6))
    assert (residual[3] < -9e5).all() and not by_camera[3].any() and not by_marker[3].any()
    for xi, slopes, f in ((camera_xi, by_camera, lambda x: adjust._residuals(x, marker_xi, pixels, camera, corners, 1e6)), (marker_xi, by_marker, lambda x: adjust._residuals(camera_xi, x, pixels, camera, corners, 1e6))):
        for k in range(6):
            h = np.zeros((n, 6))
            h[:, k] = 1e-6
            assert np.allclose(slopes[:, :, k], (f(xi + h) - f(xi - h)) / 2e-6, rtol=1e-5, atol=2e-4)


def test_registered_model_in_poses_and_points(spark, mirror):
    camera = lens("mirror", 12)
    r = np.random.default_rng(2)
    R, t = arrays.rotations(r.normal(0, 0.3, (12, 3))), np.stack([*r.uniform(-0.3, 0.3, (2, 12)), r.uniform(1, 3, 12)], 1)
    corners = np.einsum("nij,kj->nki", R, arrays.DETECTOR_CORNERS * 0.2) + t[:, None]
    pixels = arrays.project(corners, camera[:, None, :])
    assert np.allclose(arrays.unproject(pixels, camera[:, None, :]), corners / np.linalg.norm(corners, axis=-1, keepdims=True))
    d = spark.createDataFrame([(i, i, 0, "m", [tuple(map(float, p)) for p in x]) for i, x in enumerate(pixels)], "detection_id long, image_id long, marker_id long, camera_id string, corners array<struct<u:double,v:double>>")
    for row in poses.estimate_marker_poses(d, mirror, 0.2).collect():
        assert row.success and np.abs(np.array(row.T_C_M.t) - t[row.detection_id]).max() < 1e-6

    truth, centres = np.array([[0.2, 0.1, 5.0], [-0.3, 0.2, 4.0]]), np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]])
    obs = [(i, k, *map(float, mirror_project((p - c)[None], {n: np.array([float(v or 0)]) for n, v in (fx.CAMERA | {"k1": 0.1}).items() if n in arrays.CAMERA})[0])) for i, p in enumerate(truth) for k, c in enumerate(centres)]
    observations = spark.createDataFrame(obs, "track_id long, image_id long, x double, y double")
    at = spark.createDataFrame([(k, *map(float, c), "m") for k, c in enumerate(centres)], "image_id long, x double, y double, z double, camera_id string")
    P = at.select("image_id", g.pose(g.rotation_y(F.lit(1.0), F.lit(0.0)), g.vector(F.col("x"), F.col("y"), F.col("z"))).alias("T"), "camera_id")
    found = tracks.triangulate(observations, P, mirror)
    assert {x.track_id: np.round([x.x, x.y, x.z], 6).tolist() for x in found.collect()} == dict(enumerate(truth.tolist()))
    off = found.withColumn("x", F.col("x") + 0.02).withColumn("point_id", F.col("track_id")).withColumn("is_active", F.lit(True))
    assert all(np.abs(np.array([x.x, x.y, x.z]) - truth[x.point_id]).max() < 1e-5 for x in points.refine_points(off, observations, P, mirror).collect())
    o = {(i, k): (x, y) for i, k, x, y in obs}
    m = spark.createDataFrame([(i, 0, 1, *o[i, 0], *o[i, 1]) for i in range(2)], "match_id long, image_id_a long, image_id_b long, x_a double, y_a double, x_b double, y_b double")
    located = epipolar.match_geometry(m, P, mirror)
    assert all(x.epipolar_error < 1e-9 for x in epipolar.with_epipolar_error(located).collect())
    assert all(x.is_valid and np.abs(np.array([x.x, x.y, x.z]) - truth[x.match_id]).max() < 1e-6 for x in epipolar.triangulate_pairs(located).collect())


def test_a_model_without_array_functions_is_refused(spark, mirror):
    cam.register("mirror", cam.MODELS["mirror"]._replace(project_array=None))
    d = spark.createDataFrame([(0, 0, 0, "m", [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)])], "detection_id long, image_id long, marker_id long, camera_id string, corners array<struct<u:double,v:double>>")
    with pytest.raises(Exception, match="no array functions for camera model: mirror"):
        poses.estimate_marker_poses(d, mirror, 0.2).collect()


def test_registered_loss(spark):
    half = losses.Loss(lambda s, d: s / 2, lambda s, d: np.full_like(s, 0.5), lambda s, d: s / 2, lambda s, d: F.lit(0.5))
    losses.register("half", half)
    try:
        assert losses.loss("half") is half
    finally:
        del losses.LOSSES["half"]
    with pytest.raises(ValueError, match="unknown loss: half"):
        losses.loss("half")
    s = np.array([0.0, 1.0, 4.0, 9.0, 100.0])
    for name, made in losses.LOSSES.items():
        table = spark.createDataFrame([(float(x),) for x in s], "s double").select("s", made.rho_column(F.col("s"), 2.0).alias("rho"), made.weight_column(F.col("s"), 2.0).alias("w"))
        rows = sorted(table.collect())
        assert np.allclose([x.rho for x in rows], made.rho(s, 2.0)) and np.allclose([x.w for x in rows], made.weight(s, 2.0)), name
        slope = (made.rho(s + 1e-6, 2.0) - made.rho(s, 2.0)) / 1e-6
        assert np.allclose(slope, made.weight(s, 2.0), atol=1e-4)
