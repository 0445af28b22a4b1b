"""The registered queries run with the operators' own limits."""

import inspect

import pytest

from vertexmill.operators import adjust, pairs, points
from vertexmill.plans import queries

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


def limits(monkeypatch, module, name, query, spark):
    """The arguments that a query gives to an operator, defaults included."""
    signature = inspect.signature(getattr(module, name))

    def stop(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Called) as got:
        query(spark, SF)
    return got.value.args[0]


def test_default_limits(spark, monkeypatch):
    assert limits(monkeypatch, pairs, "select_frame_pairs", queries.frame_pairs, spark)["max_baseline"] == 5.0
    found = spark.createDataFrame([(1, 1, 1, True, 0.1)], "detection_id long, image_id long, marker_id long, success boolean, reprojection_error_px double")
    monkeypatch.setattr(queries.marker_poses, "estimate_marker_poses", lambda *_: found)
    monkeypatch.setattr(queries.graph, "propagate_poses", lambda *_: (None, None))
    assert limits(monkeypatch, adjust, "robust_adjust", queries.adjust_map, spark)["config"].iterations == 100
    monkeypatch.setattr(queries.tracks, "build_tracks", lambda *_: None)
    monkeypatch.setattr(queries.tracks, "triangulate", lambda *_, **__: spark.createDataFrame([(1,)], "track_id long"))
    assert limits(monkeypatch, points, "refine_points", queries.refine_points, spark)["iterations"] == 50
