"""Operators on small scenes with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import geometry as g
from vertexmill.operators import catalog, graph, points, tracks
from vertexmill.operators.components import connected_components
from vertexmill.operators.greedy import greedy_groups
from vertexmill.operators.matching import mutual_best
from vertexmill.sources.writers import marker_map


@pytest.mark.parametrize("task_edges", [1000, 2])
def test_components(spark, task_edges):
    rows = [(1, 2), (3, 2), (5, 6), (9, 9), (None, 4), (2, 1)] + [(k, k + 1) for k in range(20, 31)] + [(100, 100 + k) for k in range(1, 40)]
    edges = spark.createDataFrame(rows, "u long, v long")
    want = {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} | {(k, 20) for k in range(20, 32)} | {(k, 100) for k in range(100, 140)}
    assert {tuple(r) for r in connected_components(edges, task_edges=task_edges).collect()} == want
    assert connected_components(edges.limit(0)).count() == 0


def sequential(edges, images):
    """node to root, by edges(u, v, place) in order; images: node to set."""
    parent = {n: n for e in edges for n in e[:2]}
    held = {n: set(images.get(n, ())) for n in parent}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v, _ in sorted(edges, key=lambda e: e[2]):
        a, b = sorted((find(u), find(v)))
        if a != b and not held[a] & held[b]:
            parent[b] = a
            held[a] |= held[b]
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("task_rows", [1_000, 50])
def test_greedy_of_any_size(spark, task_rows):
    """One component far over the rows of a task, with conflicts, beside small ones, is settled as by one edge after the other."""
    r = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (110, 2))] + [(k, k + 1) for k in range(60, 72)] + [(200, 201), (201, 202), (202, 203)]
    edges = [(a, b, k) for k, (a, b) in enumerate(dict.fromkeys(tuple(sorted(e)) for e in edges if e[0] != e[1]))]
    images = {n: {int(i) for i in r.integers(0, 25, r.integers(0, 3))} for n in range(73)} | {200: {1}, 201: {2}, 202: {1}, 203: {3}}
    rows = [(n, i) for n, s in images.items() for i in s]
    got = {x.node: x.root for x in greedy_groups(spark.createDataFrame(edges, "u long, v long, place long").repartition(3), spark.createDataFrame(rows, "node long, image long"), task_rows).collect()}
    want = sequential(edges, images)
    assert got == want and len(set(want.values())) > 10


def test_greedy_refuses_a_repeated_image_in_tasks_and_in_rounds(spark):
    edges = spark.createDataFrame([(0, 10, 1), (10, 20, 2), (20, 3, 3)], "u long, v long, place long")
    images = spark.createDataFrame([(0, 0), (10, 1), (20, 2), (3, 0)], "node long, image long")
    for most in (100, 0):
        assert {tuple(r) for r in greedy_groups(edges, images, most).collect()} == {(0, 0), (10, 0), (20, 0), (3, 3)}


def test_tracks(spark):
    rows = [(0, 0, 0, 0, 1, 1, True), (1, 1, 1, 1, 2, 2, True), (2, 2, 2, 2, 0, 3, True)]
    m = spark.createDataFrame([(p, k, a, fa, float(fa), 0.0, b, fb, float(fb), 0.0, ok) for p, k, a, fa, b, fb, ok in rows], "pair_id long, match_id long, image_id_a long, feature_idx_a long, x_a double, y_a double, image_id_b long, feature_idx_b long, x_b double, y_b double, is_epipolar_inlier boolean")
    assert {(r.image_id, r.feature_idx) for r in tracks.build_tracks(m).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_sync(spark):
    old = spark.createDataFrame([("a", 10, 1, True, False, "detected", False), ("b", 5, 1, False, False, "not_run", False)], "rel_path string, size_bytes long, mtime_ms long, ignored boolean, missing boolean, detection_status string, modified_since_detection boolean")
    scan = spark.createDataFrame([("a", 11, 1)], "rel_path string, size_bytes long, mtime_ms long")
    rows = {r.rel_path: r for r in catalog.sync_catalog(old, scan).collect()}
    assert (rows["a"].change, rows["a"].detection_status, rows["a"].modified_since_detection, rows["a"].ignored) == ("updated", "stale", True, True)
    assert rows["b"].change == "missing" and rows["b"].missing


def test_seed_propagation(spark):
    edges = spark.createDataFrame([(1, 0, 0, 0.0, 0.1), (2, 0, 1, 1.0, 0.2), (3, 1, 2, 0.0, None)], "obs_id long, image_id long, marker_id long, x double, err double").withColumn("T_C_M", g.pose(g.rotation_y(F.lit(1.0), F.lit(0.0)), g.vector(F.col("x"), 0, 1)))
    cameras, markers = graph.propagate_poses(edges, 0)
    assert [r.T.t for r in cameras.collect()] == [[0.0, 0.0, -1.0]]
    assert {r.marker_id: r.T.t for r in markers.collect()} == {0: [0.0, 0.0, 0.0], 1: [1.0, 0.0, 0.0]}


def test_marker_map(spark):
    poses = spark.range(2).select(F.col("id").alias("marker_id"), g.identity().alias("T"))
    rows = [tuple(r) for r in marker_map(poses, 2.0).orderBy("id").collect()]
    assert [r[0] for r in rows] == list(range(8)) and rows[0] == (0, -1.0, -1.0, 0.0)
    with pytest.raises(Exception, match="out of range"):
        marker_map(spark.range(1 << 30, (1 << 30) + 1).select(F.col("id").alias("marker_id"), g.identity().alias("T")), 1.0).collect()


def test_radius_pairs(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.005, 0.0, 0.0), (3, 1.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert [(r.i, r.j) for r in points.radius_pairs(p, 0.02).collect()] == [(1, 2)]
    assert points.radius_pairs(p, 0.0).count() == 0


def test_square_pose_recovers_the_truth():
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.3, (200, 3))
    t = np.stack([rng.uniform(-0.5, 0.5, 200), rng.uniform(-0.5, 0.5, 200), rng.uniform(2, 4, 200)], 1)
    R = arrays.rotations(r)
    p = np.einsum("nij,kj->nki", R, arrays.DETECTOR_CORNERS * 0.2) + t[:, None]
    Rs, ts = arrays.squares_to_poses(p[..., :2] / p[..., 2:], 0.2)
    error = np.abs(Rs - R[:, None]).max((2, 3)) + np.abs(ts - t[:, None]).max(2)
    assert error.min(1).max() < 1e-6
    assert np.allclose(arrays.rotation_vectors(R), r)


def test_mutual_best_blocks_agree():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 8)), rng.normal(size=(40, 8))
    one, two = mutual_best(a, b, 0.1), mutual_best(a, b, 0.1, block=7)
    assert all(np.array_equal(x, y) for x, y in zip(one[:2], two[:2], strict=True))
