"""Marker poses are estimated on batches of arrays."""

import numpy as np
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.operators import poses
from vertexmill.plans import fixtures as fx


def test_poses_are_estimated_as_arrays(spark):
    """Every row comes back with its pose or its reason; corners and cameras reach the tasks as flat columns."""
    x = arrays.DETECTOR_CORNERS * 0.25
    seen = [tuple(map(float, p)) for p in 500 * (x[:, :2] + [0.1, -0.2]) / 2.0 + [320, 240]]
    given = {0: ("c", seen), 1: ("c", None), 2: ("c", seen[:3]), 3: ("c", [*seen[:3], None]), 4: ("c", [*seen[:3], (None, 1.0)]), 5: ("x", seen), 6: ("n", seen), 7: ("c", [seen[0]] * 4), 8: ("c", seen)}
    d = spark.createDataFrame([(k, k, 3, c, p) for k, (c, p) in given.items()], "detection_id long, image_id long, marker_id long, camera_id string, corners array<struct<u:double,v:double>>").coalesce(1)
    cameras = fx.cameras(spark)
    one = cameras.filter("camera_id = 'c'")
    cameras = cameras.union(one.withColumns({"camera_id": F.lit("x"), "model": F.lit("fisheye")})).union(one.withColumns({"camera_id": F.lit("n"), "k1": F.lit(None).cast("double")}))
    found = poses.estimate_marker_poses(d, cameras, 0.25)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "lambda" not in text
    got = {r.detection_id: r for r in found.collect()}
    assert got.keys() == given.keys()
    for k in (0, 8):
        assert got[k].success and got[k].error_message is None and np.allclose(got[k].T_C_M.t, [0.1, -0.2, 2.0]) and np.allclose(got[k].T_C_M.R, np.eye(3), atol=1e-6)
    for k in (1, 2, 3, 4):
        assert (got[k].success, got[k].T_C_M, got[k].reprojection_error_px, got[k].error_message) == (False, None, None, "four corners are needed")
    for k in (5, 6):
        assert got[k].error_message == "a corner does not unproject to a forward ray"
    assert not got[7].success and got[7].error_message
