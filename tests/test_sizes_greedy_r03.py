"""Greedy groups of graphs of one component: settled in passes over all groups, not a few first edges at a time."""

import numpy as np

from vertexmill.operators import greedy


def test_a_large_component_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], greedy._round
    monkeypatch.setattr(greedy, "_round", lambda *a: rounds.append(1) or plain(*a))
    r = np.random.default_rng(8)
    n, name = 400, r.permutation(400)
    ends = [(name[a], name[(a + k) % n]) for a, k in zip(r.integers(0, n, 1600), r.integers(1, 8, 1600), strict=True)]
    edges = sorted({(int(min(e)), int(max(e))) for e in ends})
    images = [(i, m) for i in range(n) for m in (i % 5, 10 + i % 7)]
    parent, held = list(range(n)), {i: {i % 5, 10 + i % 7} for i in range(n)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        if a != b and not held[a] & held[b]:
            parent[b] = a
            held[a] |= held[b]
    rows = [(a, b, k) for k, (a, b) in enumerate(edges)]
    found = greedy.greedy_groups(spark.createDataFrame(rows, "u long, v long, place long").repartition(3), spark.createDataFrame(images, "node long, image long"), 100)
    assert {x.node: x.root for x in found.collect()} == {i: find(i) for e in edges for i in e}
    assert len(rounds) <= 2
