"""Bundle adjustment beyond the markers that the driver solves for."""

import numpy as np
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import geometry as g
from vertexmill.operators import adjust
from vertexmill.plans import fixtures as fx


def scene(spark):
    """Five images of four markers, seeds a few centimetres off."""
    c, corners, rows = fx.CAMERA, arrays.DETECTOR_CORNERS * 0.2, []
    centres = {m: np.array([m * 0.5, m % 2 * 0.3, 3.0 + 0.2 * m]) for m in range(4)}
    centres[0] = np.zeros(3)
    images = {i: np.array([0.3 * i - 0.5, 0.1 * i, -3.0 - 0.1 * i]) for i in range(5)}
    for i, at in images.items():
        for m, centre in centres.items():
            p = corners + centre - at
            rows.append((i, m, "c", [(float(c["fx"] * x / z + c["cx"] + 0.1 * ((i + m) % 3)), float(c["fy"] * y / z + c["cy"])) for x, y, z in p]))
    observations = spark.createDataFrame(rows, "image_id long, marker_id long, camera_id string, corners array<struct<u:double,v:double>>")

    def poses(places, key, off):
        table = spark.createDataFrame([(k, *(float(x) + off for x in v)) for k, v in places.items()], f"{key} long, x double, y double, z double")
        return table.select(key, g.pose(g.rotation_y(F.lit(1.0), F.lit(0.0)), g.vector(F.col("x"), F.col("y"), F.col("z"))).alias("T"))

    return observations, poses(images, "image_id", 0.02), poses(centres, "marker_id", -0.03)


def test_the_three_solvers_agree(spark, monkeypatch):
    """Directly, by conjugate gradients on the driver, and by conjugate gradients over tables of several pieces."""
    observations, images, markers = scene(spark)

    def run():
        done = adjust.bundle_adjust(observations, images, markers, fx.camera(spark), 0.2, 0, adjust.Config(iterations=2))
        return done.summary, {r.marker_id: r.xi for r in done.marker_poses.select("marker_id", g.to_vector(F.col("T")).alias("xi")).collect()}

    few, at_few = run()
    monkeypatch.setattr(adjust, "MOST_MARKERS", 1)
    monkeypatch.setattr(adjust, "RESIDUAL", 1e-10)
    driver = run()
    monkeypatch.setattr(adjust, "MOST_BLOCKS", 1)
    monkeypatch.setattr(adjust, "PIECE_MARKERS", 2)
    for many, at_many in (driver, run()):
        assert few["num_markers"] == many["num_markers"] == 4 and few["num_iterations"] == many["num_iterations"] == 2
        assert few["final_cost"] < few["initial_cost"] and np.isclose(few["final_cost"], many["final_cost"], rtol=1e-6)
        assert at_few.keys() == at_many.keys() and all(np.allclose(at_few[m], at_many[m], atol=1e-7) for m in at_few)
        assert at_few[0] == [0.0] * 6
