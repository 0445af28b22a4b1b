"""Nearest neighbours against brute force: ties, repeats, odd vectors, lengths, empty tables, factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.llm import vptree


def brute(rows, queries, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q in queries:
        if q in good:
            near = []
            for i, v in good.items():
                if i != q and len(v) == len(good[q]):
                    d = 0.0
                    for x, y in zip(good[q], v, strict=True):
                        d += (float(x) - float(y)) ** 2
                    near.append((np.sqrt(d), i))
            out += [(q, r + 1, i, float(d)) for r, (d, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 6)).astype(np.float32).round(1)  # many equal distances
    out = [(i, x.tolist()) for i, x in enumerate(v)]
    out += [(400 + i, v[0].tolist()) for i in range(60)]  # one vector, very often
    out += [(100, None), (500, None), (600, []), (700, [0.0] * 6), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (1000, [None] * 6), (None, v[1].tolist())]
    out += [(1100 + 100 * i, x) for i, x in enumerate(rng.normal(size=(5, 3)).astype(np.float32).tolist())]  # of another length
    out += [(0, v[0].tolist()), (200, v[5].tolist()), (200, v[200].tolist())]  # repeated ids
    return out


@pytest.mark.parametrize("shard_rows", [70, 10_000])
def test_against_brute_force(spark, rows, shard_rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "shard": F.lit(1), "score": F.lit(None), "QUERY": F.lit(0)}).repartition(5)
    queries = df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(df, queries, shard_rows=shard_rows, leaf=8).collect())
    assert got == brute(rows, [i for i in range(0, 1600, 100)])


def test_empty_and_factor(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    assert vptree.nearest(df.limit(0), queries).count() == vptree.nearest(df, queries.limit(0)).count() == 0
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest(df, queries, leaf=8).collect()}
    loose = {(r.query_id, r.vec_id) for r in vptree.nearest(df, queries, factor=1.3, leaf=8).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)


def test_vantage_points_leave_their_subtrees():
    tree = vptree.Tree(np.random.default_rng(0).normal(size=(500, 4)), 16)
    seen = []

    def walk(node):
        if isinstance(node, np.ndarray):
            seen.extend(node.tolist())
        else:
            seen.extend(node[0].tolist())
            walk(node[2])
            walk(node[3])

    walk(tree.root)
    assert sorted(seen) == list(range(500))
