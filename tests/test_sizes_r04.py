"""Steps that failed, differed or left work out on larger tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.operators import epipolar, graph, greedy, tracks
from vertexmill.plans import fixtures as fx
from vertexmill.plans import queries

SF = "/root/testdata/sf0.001"


def test_numbers_are_rounded_as_the_sql_does(spark):
    """Next to ties of the sixth digit too, where the shortest decimal goes the other way."""
    tie = (np.arange(0, 2_000_000, 997) + 0.5) / 1e6
    x = np.concatenate([tie, np.nextafter(tie, 0), np.nextafter(tie, 3), -tie, [0.0005045, 0.0009945, np.inf, -np.inf, 0.0, 123456.7654321]])
    got = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x double").select("k", fx.rounded(F.col("x")).alias("x"), F.round("x", 6).alias("plain")).orderBy("k").toPandas()
    want = np.array([r for (r,) in duckdb.sql(f"SELECT round(v, 6) FROM (VALUES {', '.join(f'({k}, {float(v)!r}::DOUBLE)' if np.isfinite(v) else f'''({k}, '{v}'::DOUBLE)''' for k, v in enumerate(x))}) AS t(k, v) ORDER BY k").fetchall()])
    assert (got["plain"].to_numpy() != want).any()
    assert (got["x"].to_numpy() == want).all()


def test_each_two_images_are_matched(spark, tmp_path):
    """However far apart their ids are; as the SQL, which has no such bound either."""
    r = np.random.default_rng(4)
    images = (0, 3, 9, 14, 40, 1000)
    rows = [(k, [float(x) for x in r.normal(size=6)], images[k % 6]) for k in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.mutual_match(spark, str(tmp_path)).collect()
    assert {(x.image_id_a, x.image_id_b) for x in got} == {(a, b) for a in images for b in images if a < b}
    sql = f"WITH embeddings AS (SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')), " + queries.oracles()["mutual_match"].removeprefix("WITH ")
    assert sorted(tuple(x) for x in got) == sorted(duckdb.sql(sql).fetchall())


def grouped(edges, images):
    """{node: root} by the rule, edge by edge."""
    parent, held = {n: n for e in edges for n in e}, {n: set(images.get(n, ())) for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        if a != b and not held[a] & held[b]:
            parent[b] = a
            held[a] |= held[b]
    return {n: find(n) for n in parent}


def test_many_small_components_are_settled_at_once(spark, monkeypatch):
    """In few steps over all edges, however many there are beside task_rows, by places of two fields."""
    steps, keep = [], greedy.written
    monkeypatch.setattr(greedy, "written", lambda df: steps.append(1) or keep(df))
    r = np.random.default_rng(5)
    edges = [(int(10 * c + a), int(10 * c + b)) for c in range(120) for a, b in [sorted(r.choice(8, 2, replace=False)) for _ in range(9)]]
    r.shuffle(edges)
    edges = [tuple(map(int, e)) for e in edges]
    images = {n: {n % 10 % 5} for n in range(1200)}
    rows = [(u, v, (None if k < 2 else k // 3, 7 * k % 3 if k % 3 else 0)) for k, (u, v) in enumerate(edges)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][2][0] is not None, rows[k][2][0] or 0, rows[k][2][1], k))
    assert len({x[2] for x in rows}) == len(rows)
    df = spark.createDataFrame(rows, "u long, v long, place struct<a: long, b: long>").repartition(3)
    found = greedy.greedy_groups(df, spark.createDataFrame([(n, i) for n, s in images.items() for i in s], "node long, image long"), 60)
    assert {x.node: x.root for x in found.collect()} == grouped([edges[k] for k in order], images)
    assert len(steps) <= 10


def test_tracks_are_counted_without_coordinates_and_with_one_search_for_components(spark, monkeypatch):
    want = sorted(tuple(x) for x in queries.track_components(spark, SF).collect())
    calls, plain = [], greedy.connected_components
    monkeypatch.setattr(greedy, "connected_components", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(tracks, "first_coordinates", lambda m: calls.append(2))
    assert sorted(tuple(x) for x in queries.track_components(spark, SF).collect()) == want and want
    assert not calls


@pytest.mark.parametrize("many", [False, True])
def test_a_dense_component_is_settled_by_prefixes(spark, monkeypatch, many):
    """In few steps, not an edge a group at a time; with few images and with many, some of which no other node has."""
    steps, keep = [], greedy.written
    monkeypatch.setattr(greedy, "written", lambda df: steps.append(1) or keep(df))
    r = np.random.default_rng(6)
    edges = sorted({tuple(sorted(map(int, r.choice(300, 2, replace=False)))) for _ in range(4000)})
    images = {n: {n % 5, 10 + n % 7} | ({100 + n % 90, 1000 + n} if many else set()) for n in range(300)}
    df = spark.createDataFrame([(u, v, k) for k, (u, v) in enumerate(edges)], "u long, v long, place long").repartition(3)
    found = greedy.greedy_groups(df, spark.createDataFrame([(n, i) for n, s in images.items() for i in s], "node long, image long"), 1500)
    assert {x.node: x.root for x in found.collect()} == grouped(edges, images)
    assert len(steps) <= 30, len(steps)


def test_prefixes_of_long_image_lists_and_of_edges_one_by_one(spark, monkeypatch):
    """Lists that are not compared beforehand, and tasks of two edges."""
    monkeypatch.setattr(greedy, "LISTED_IMAGES", 2)
    r = np.random.default_rng(9)
    edges = sorted({tuple(sorted(map(int, r.choice(9, 2, replace=False)))) for _ in range(14)})
    images = {n: {n % 4, 20 + n % 3, 30 + n} for n in range(9)}
    df = spark.createDataFrame([(u, v, k) for k, (u, v) in enumerate(edges)], "u long, v long, place long")
    found = greedy.greedy_groups(df, spark.createDataFrame([(n, i) for n, s in images.items() for i in s], "node long, image long"), 2)
    assert {x.node: x.root for x in found.collect()} == grouped(edges, images)


def test_pairs_of_images_come_from_lists(spark, monkeypatch):
    """What is shuffled for the pairs are rows of lists, a row for each two blocks of images; pairs are those of all against all."""
    monkeypatch.setattr(graph, "LISTED_ROWS", 8, raising=False)
    monkeypatch.setattr(graph, "OUT_ROWS", 10, raising=False)
    rows = [(i, m) for i in range(60) for m in ({i % 2, 10 + i % 3} if i < 54 else {i})] + [(0, 0), (None, 1), (5, None)]
    seen = spark.createDataFrame(rows, "image_id int, marker_id long")
    got = graph.common_markers(seen)
    by = {i: {m for j, m in rows if j == i and m is not None} for i in range(60)}
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, len(by[a] & by[b])) for a in by for b in by if a < b and by[a] & by[b])
    assert got.schema["image_id_a"].dataType.simpleString() == "int"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "images_a" in plan and "images_b" in plan
    assert graph.common_markers(seen.limit(0)).count() == 0


@pytest.mark.parametrize("looked_up", [0, 20_000])
def test_errors_of_all_types_come_from_one_pass(spark, monkeypatch, looked_up):
    """To the last bit those of each type alone, without poses, cameras or ids too, whether poses are looked up or joined."""
    monkeypatch.setattr(epipolar, "LOOKED_UP", looked_up)
    r = np.random.default_rng(11)
    rows = [(k, *[int(x) for x in r.integers(0, 45, 2)], *[float(x) for x in r.integers(100, 500, 4)]) for k in range(3000)] + [(3000, None, 1, 1.0, 2.0, 3.0, 4.0), (3001, 1, 2, None, 2.0, 3.0, 4.0)]
    m = spark.createDataFrame(rows, "match_id long, image_id_a long, image_id_b long, x_a double, y_a double, x_b double, y_b double").repartition(3)
    P = fx.poses(spark, SF).filter("image_id % 40 < 38").withColumn("camera_id", F.element_at(F.array(*[F.lit(c) for c in "cdon"]), (F.col("image_id") % 4 + 1).cast("int")))
    cameras = fx.cameras(spark)
    kinds = ("ray_angular", "sampson", "no such")
    located = epipolar.match_geometry(m, P, cameras)
    want = {(kind, x.match_id): (repr(x.epipolar_error), x.is_epipolar_inlier) for kind in kinds for x in epipolar.with_epipolar_error(located, kind, min_baseline=0.5).collect()}
    got = epipolar.match_errors(m, P, cameras, error_types=kinds, min_baseline=0.5).collect()
    assert len(got) == len(want) > 1000 and {(x.error_type, x.match_id): (repr(x.epipolar_error), x.is_epipolar_inlier) for x in got} == want
    assert epipolar.match_errors(m.limit(0), P, cameras).count() == 0


def test_a_match_goes_to_python_once(spark):
    assert queries.epipolar_strict(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
