"""Components, overlaps and matches of large tables."""

import random

import pytest

from vertexmill.functions import geometry as g
from vertexmill.operators import components, graph


def test_neighbouring_links_take_no_rounds(spark, monkeypatch):
    """Components of close ids are contracted within tasks; what is left is settled in a task."""
    def refuse(*_):
        raise AssertionError("a round over all links")

    monkeypatch.setattr(components, "_small_star", refuse)
    rows = [(10 * c + k, 10 * c + k + 1) for c in range(600) for k in range(6)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "u long, v long")
    got = {tuple(r) for r in components.connected_components(df, task_edges=400).collect()}
    assert got == {(10 * c + k, 10 * c) for c in range(600) for k in range(7)}


@pytest.mark.parametrize("chunk", [5, components.CHUNK_LINKS])
def test_components_of_random_links(spark, monkeypatch, chunk):
    """With hubs, loops, repeated links and null ends, over chunks of a few links and rounds."""
    monkeypatch.setattr(components, "CHUNK_LINKS", chunk)
    r = random.Random(chunk)
    rows = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(700, k) for k in range(600, 640)] + [(5, 5), (900, 900), (None, 3), (901, None)] + [(1, 2)] * 30
    root = {n: n for u, v in rows for n in (u, v) if n is not None and u is not None and v is not None and u != v}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in rows:
        if u is not None and v is not None and u != v:
            a, b = sorted((top(u), top(v)))
            root[b] = a
    df = spark.createDataFrame(rows, "u long, v long").repartition(4)
    got = [tuple(x) for x in components.connected_components(df, task_edges=2).collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, top(n)) for n in root}


def test_only_crowded_images_are_dealt_into_blocks(spark, monkeypatch):
    """Markers of other images are paired in the image's row; pairs are those of all against all."""
    dealt, met = [], graph.met_pairs

    def watched(seen, *rest):
        dealt.extend(r.image_id for r in seen.collect())
        return met(seen, *rest)

    monkeypatch.setattr(graph, "BLOCK_ROWS", 6)
    monkeypatch.setattr(graph, "met_pairs", watched)
    r = random.Random(1)
    rows = [(i, r.randrange(12)) for i in range(30) for _ in range(r.randrange(1, 6))] + [(99, m) for m in range(9)] + [(None, 1), (None, 2), (3, None)]
    got = sorted(tuple(x) for x in graph.overlap_pairs(spark.createDataFrame(rows, "image_id long, marker_id long")).collect())
    by = {i: {m for j, m in rows if j == i and m is not None} for i, _ in rows if i is not None}
    assert got == sorted((a, b, i) for i, ms in by.items() for a in ms for b in ms if a < b)
    assert set(dealt) == {99}


def test_edges_of_other_components_are_not_shuffled(spark, monkeypatch):
    """Beside the few markers of the anchor's component; beside many, both sides are."""
    plans, keep = [], graph.written

    def watched(df):
        if "T_C_M" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "written", watched)
    rows = [(10 * c + k, 10 * c + k // 2, 10 * c + k % 2, 0.5 + k) for c in range(8) for k in range(4)]
    df = spark.createDataFrame(rows, "obs_id long, image_id long, marker_id long, err double").withColumn("T_C_M", g.identity())
    found = [sorted((r.image_id, r.score) for r in graph.propagate_poses(df, 0, most)[0].collect()) for most in (1000, 0)]
    assert found[0] == found[1] == [(0, 0.5), (1, 2.5)]
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "Broadcast" not in plans[1]
