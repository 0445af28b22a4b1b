"""The scene and the adjustment of many images."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from tests.test_adjust_many import scene
from vertexmill.functions import geometry as g
from vertexmill.operators import adjust
from vertexmill.plans import fixtures as fx
from vertexmill.plans import queries

SF = "/root/testdata/sf0.001"


def test_the_scene_is_plain_arithmetic(spark):
    """Corners are those of the poses' own transforms; no function of a row's arrays is left in the plan, which was evaluated anew for each use."""
    found = queries._scene(spark, SF)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    c = fx.CAMERA
    rows = found.collect()
    assert rows
    for r in rows[:200]:
        R, t = np.array(r.T.R), np.array(r.T.t)
        for k, (x, y) in enumerate(g.CORNER_ORDERS["detector"]):
            q = R.T @ (np.array(r.M.R) @ np.array([x, y, 0]) * queries.SIZE / 2 + np.array(r.M.t) - t)
            off = [((r.image_id * 31 + r.marker_id * 17 + j) % 11 - 5) / 100 for j in (k, k + 3)]
            assert q[2] > 1 and np.allclose([q[0] / q[2] * c["fx"] + c["cx"] + off[0], q[1] / q[2] * c["fy"] + c["cy"] - off[1]], [r.corners[k].u, r.corners[k].v], atol=1e-9)


@pytest.mark.parametrize("rows", [3, adjust.BUCKET_ROWS])
def test_buckets_are_arrays(spark, monkeypatch, rows):
    """The adjustment takes no row apart in Python, and several buckets, cameras and images without a marker of their own make no difference."""
    def refuse(*_):
        raise AssertionError("rows are taken apart one at a time")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", refuse)
    monkeypatch.setattr(adjust, "BUCKET_ROWS", rows)
    monkeypatch.setattr(adjust, "ROWS_AT_ONCE", 2)
    observations, images, markers = scene(spark)
    observations = observations.filter("image_id <> 2 or marker_id = 3").withColumn("camera_id", F.when(F.col("image_id") == 4, "d").otherwise("c"))
    done = adjust.bundle_adjust(observations, images, markers, fx.cameras(spark), 0.2, 0, adjust.Config(iterations=6))
    assert done.summary["num_markers"] == 4 and done.summary["final_cost"] < 0.05 * done.summary["initial_cost"]
    errors = adjust.residual_rows(observations, done.camera_poses, done.marker_poses, fx.cameras(spark), 0.2)
    assert errors.count() == 4 * observations.count()
    s = errors.groupBy("image_id", "marker_id").agg(F.sum(F.col("error_px") ** 2).alias("s"))
    cost = s.agg(F.sum(0.5 * F.when(F.col("s") <= 9, F.col("s")).otherwise(6 * F.sqrt("s") - 9))).first()[0]
    assert np.isclose(cost, done.summary["final_cost"], rtol=1e-6)
