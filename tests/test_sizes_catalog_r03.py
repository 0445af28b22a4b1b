"""Replaced rows of large tables."""

from vertexmill.operators import catalog


def test_old_rows_pass_unsorted(spark):
    """A task holds its part of the keys only, also where these are too many to be sent to all tasks; null keys stay."""
    old = spark.createDataFrame([(k, k % 7 if k % 5 else None) for k in range(60)], "detection_id long, image_id long")
    keys = spark.createDataFrame([(3,), (3,), (4,), (None,)], "image_id long")
    new = spark.createDataFrame([(100, 3)], "detection_id long, image_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = catalog.replace_by_key(old, new, keys, ["image_id"])
        text = made._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.detection_id, r.image_id) for r in made.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in text and "Sort" not in text.replace("SortAggregate", "")
    assert got == [(k, k % 7 if k % 5 else None) for k in range(60) if not k % 5 or k % 7 not in (3, 4)] + [(100, 3)]
