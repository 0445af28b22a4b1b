"""Frame pairs and shared markers against all pairs, seed poses against turns in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import geometry as g
from vertexmill.operators import graph, pairs


def _poses(spark, centres, turns):
    rows = [(i, *map(float, c), float(np.cos(a)), float(np.sin(a))) for i, (c, a) in enumerate(zip(centres, turns, strict=True))]
    table = spark.createDataFrame(rows, "image_id long, x double, y double, z double, c double, s double").repartition(3)
    return table.select("image_id", g.pose(g.rotation_y(F.col("c"), F.col("s")), g.vector(F.col("x"), F.col("y"), F.col("z"))).alias("T"))


def brute(centres, turns, markers, most, least=0.03, farthest=5.0, min_common=0, bonus=True):
    n, by = len(centres), {}
    for a in range(n):
        for b in range(a + 1, n):
            d = float(np.sqrt(((centres[a] - centres[b]) ** 2).sum()))
            turn = np.degrees(np.arccos(np.clip(np.cos(turns[a]) * np.cos(turns[b]) + np.sin(turns[a]) * np.sin(turns[b]), -1, 1)))
            common = len(markers.get(a, set()) & markers.get(b, set()))
            if least <= d <= farthest and turn <= 60 and common >= min_common:
                row = (-(1 / (1 + d) + 0.2 * common * bonus), a, b, common)
                by.setdefault(a, []).append(row)
                by.setdefault(b, []).append(row)
    return {r[1:] for rows in by.values() for r in sorted(rows)[:most]}


@pytest.mark.parametrize("spread, most, kw", [((4, 3, 1), 10, {}), ((60, 2, 2), 3, {"min_common": 1}), ((0.2, 0.2, 0.2), 5, {}), ((9, 9, 9), 4, {"bonus": False})])
def test_best_pairs(spark, spread, most, kw):
    r = np.random.default_rng(11)
    n = 220
    centres = np.round(r.uniform(0, 1, (n, 3)) * spread, 3)
    centres[200:] = centres[:20]  # twice in one place
    centres[:9] += 40.0  # a few far from the rest
    turns = r.integers(0, 8, n) * np.pi / 4 + 0.01
    markers = {i: {int(m) for m in r.integers(0, 12, r.integers(0, 5))} for i in range(0, n, 1) if i % 10}
    seen = spark.createDataFrame([(i, m) for i, s in markers.items() for m in s], "image_id long, marker_id long")
    chosen = pairs.select_frame_pairs(_poses(spark, centres, turns), seen.union(seen), most=most, **kw).collect()
    assert {(x.image_id_a, x.image_id_b, x.common_marker_count) for x in chosen} == brute(centres, turns, markers, most, **kw) and len({x[:2] for x in chosen}) == len(chosen) > 50
    assert pairs.select_frame_pairs(_poses(spark, centres[:1], turns[:1]), seen).count() == 0


def test_markers_of_very_many_images(spark):
    r = np.random.default_rng(2)
    rows = {(k, 1) for k in range(150)} | {(int(i), int(m)) for i, m in zip(r.integers(0, 150, 200), r.integers(2, 30, 200), strict=True)}
    seen = spark.createDataFrame(list(rows), "image_id long, marker_id long")
    want = {(m, a, b) for m in range(30) for a in range(150) if (a, m) in rows for b in range(a + 1, 150) if (b, m) in rows}
    for most in (7, 1000):
        got = [tuple(x) for x in graph.met_pairs(seen, "marker_id", "image_id", most).collect()]
        assert len(got) == len(want) and set(got) == want


def turns_of(edges, anchor):
    """Scores, sources, edges and poses by the rule, a turn at a time."""
    known, frontier, side = {1: {anchor: (0.0, None, None, np.eye(4))}, 0: {}}, {anchor}, 1
    while frontier:
        offers = {}
        for obs, image, marker, err, T in edges:
            s, t = (marker, image) if side else (image, marker)
            if err is not None and s in frontier:
                offer = (err, s, obs)
                if t not in offers or offer < offers[t][:3]:
                    offers[t] = (*offer, known[side][s][3] @ (np.linalg.inv(T) if side else T))
        side = 1 - side
        frontier = {t for t, o in offers.items() if t not in known[side] or o[0] < known[side][t][0]}
        known[side] |= {t: offers[t] for t in frontier}
    return known


@pytest.mark.parametrize("task_edges", [graph.TASK_EDGES, 0])
def test_seed_poses_on_random_graphs(spark, task_edges, monkeypatch):
    monkeypatch.setattr(graph, "COMPACT_TURNS", 2)
    r = np.random.default_rng(5)
    edges = []
    for obs in range(70):
        T = np.eye(4)
        T[:3, :3], T[:3, 3] = arrays.rotations(r.normal(0, 1, (1, 3)))[0], r.normal(0, 1, 3)
        edges.append((obs, int(r.integers(0, 16)), int(r.integers(0, 14)) + (20 if obs % 17 == 0 else 0), None if obs % 13 == 0 else float(r.integers(1, 9)) / 4, T))
    anchor = edges[1][2]
    rows = [(o, i, m, e, {"R": T[:3, :3].tolist(), "t": T[:3, 3].tolist()}) for o, i, m, e, T in edges]
    df = spark.createDataFrame(rows, "obs_id long, image_id long, marker_id long, err double, T_C_M struct<R:array<array<double>>,t:array<double>>").repartition(3)
    want = turns_of(edges, anchor)
    cameras, markers = graph.propagate_poses(df, anchor, task_edges)
    for found, key, side in ((cameras.collect(), "image_id", 0), (markers.collect(), "marker_id", 1)):
        assert {x[key]: (x.score, x.source_id, x.obs_id) for x in found} == {n: v[:3] for n, v in want[side].items()} and len(found) > 5
        assert all(np.allclose(x.T.R, want[side][x[key]][3][:3, :3]) and np.allclose(x.T.t, want[side][x[key]][3][:3, 3]) for x in found)
    assert all(x.is_anchor == (x.marker_id == anchor) for x in markers.collect())
    assert [x.count() for x in graph.propagate_poses(df, 999, task_edges)] == [0, 0]
    assert [x.count() for x in graph.propagate_poses(df.limit(0), anchor, task_edges)] == [0, 0]


def test_a_chain_of_a_thousand_markers(spark):
    rows = [(2 * i + k, i, i + k, float(k), 0.1 + i / 1e4) for i in range(1000) for k in (0, 1)]
    edges = spark.createDataFrame(rows, "obs_id long, image_id long, marker_id long, x double, err double")
    edges = edges.withColumn("T_C_M", g.pose(g.rotation_y(F.lit(1.0), F.lit(0.0)), g.vector(F.col("x"), 0, 2)))
    _, markers = graph.propagate_poses(edges, 0)
    assert {x.marker_id: round(x.x, 6) for x in markers.select("marker_id", F.col("T.t")[0].alias("x")).collect()} == {i: float(i) for i in range(1001)}
