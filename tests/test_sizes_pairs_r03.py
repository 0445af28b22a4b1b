"""Frame pairs over crowded cells: compared as arrays, in groups of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.functions import geometry as g
from vertexmill.operators import pairs


@pytest.mark.parametrize("most, limit", [(4, 60.0), (4, 0.0), (200, 180.0)])
def test_a_crowded_cell_is_dealt_into_groups(spark, monkeypatch, most, limit):
    """Pairs are those of all against all, with images in one place, equal scores and angles at the limit."""
    monkeypatch.setattr(pairs, "CELL_ROWS", 7)
    monkeypatch.setattr(pairs, "AROUND_ROWS", 11)
    r = np.random.default_rng(4)
    n = 70
    at = r.integers(0, 4, (n, 3)) / 10
    turn = r.integers(0, 3, n)
    seen = {(i, int(m)) for i in range(n) for m in (i % 3, 3 + i % 2)}
    cos, sin = np.array([(1.0, 0.0), (0.8, 0.6), (0.0, 1.0)])[turn].T
    rows = [(i, *map(float, at[i]), float(cos[i]), float(sin[i])) for i in range(n)]
    table = spark.createDataFrame(rows, "image_id long, x double, y double, z double, c double, s double")
    poses = table.select("image_id", g.pose(g.rotation_y(F.col("c"), F.col("s")), g.vector(F.col("x"), F.col("y"), F.col("z"))).alias("T"))
    got = pairs.select_frame_pairs(poses, spark.createDataFrame(sorted(seen), "image_id long, marker_id long"), max_angle_deg=limit, most=most).collect()
    by = {i: [] for i in range(n)}
    for a in range(n):
        for b in range(a + 1, n):
            x, y, z = at[a] - at[b]
            d = float(np.sqrt(x * x + y * y + z * z))
            angle = float(np.degrees(np.arccos(min(1.0, sin[a] * sin[b] + cos[a] * cos[b]))))
            if 0.03 <= d <= 5 and angle <= limit:
                common = (a % 3 == b % 3) + (a % 2 == b % 2)
                row = (-(1 / (1 + d) + 0.2 * common), a, b)
                by[a].append(row)
                by[b].append(row)
    want = {row[1:]: -row[0] for of in by.values() for row in sorted(of)[:most]}
    assert {(x.image_id_a, x.image_id_b): x.estimated_overlap_score for x in got} == want and len(got) == len(want)
