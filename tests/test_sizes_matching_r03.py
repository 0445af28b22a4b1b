"""Matches of images with many features."""

import numpy as np
import pytest

from vertexmill.operators import matching

SCHEMA = "image_id long, feature_idx long, descriptor array<float>"


@pytest.mark.parametrize("normalise", [False, True])
def test_images_of_many_features_are_matched_by_blocks(spark, monkeypatch, normalise):
    """A group holds two blocks; matches are those of whole images, ties, negative products and repeated features included."""
    r = np.random.default_rng(7)
    rows = [(i, k, [float(x) for x in r.integers(-2, 3, 3)]) for i, n in ((0, 60), (1, 45), (2, 4), (3, 5)) for k in range(n)]
    rows += [(0, 3, rows[3][2]), (1, 200, None), (4, 0, [1.0, 2.0])]
    features = spark.createDataFrame(rows, SCHEMA)
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "image_id_a long, image_id_b long")

    def found():
        return sorted(tuple(x) for x in matching.match_pairs(features, pairs, 0.1, normalise).collect())

    whole = found()
    monkeypatch.setattr(matching, "GROUP_ROWS", 10)
    blocks = found()
    assert len(whole) > 20 and [x[:4] for x in blocks] == [x[:4] for x in whole] and np.allclose([x[4] for x in blocks], [x[4] for x in whole], atol=1e-12)


def test_a_group_is_bounded(spark, monkeypatch):
    """By blocks, not by an image's features."""
    monkeypatch.setattr(matching, "GROUP_ROWS", 20)
    features = spark.createDataFrame([(i, k, [1.0 * k, 1.0]) for i in range(2) for k in range(200)], SCHEMA)
    seen, keep = [], matching.written

    def watched(df):
        seen.append(df)
        return keep(df)

    monkeypatch.setattr(matching, "written", watched)
    matching.match_pairs(features, spark.createDataFrame([(0, 1)], "image_id_a long, image_id_b long")).count()
    groups = [df for df in seen if df.columns == ["image_id_a", "image_id_b", "x", "y"]]
    assert groups and groups[0].count() == 100
