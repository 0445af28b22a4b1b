"""What the pipeline's stages leave to the driver."""

import numpy as np
import pytest

from vertexmill.llm import jaccard, quality


def size_of_plan(df):
    return len(df._jdf.queryExecution().toString())


@pytest.mark.parametrize("stage", [quality.keep, quality.judge])
def test_the_ratios_do_not_stand_in_the_plan(spark, stage):
    """Not as a literal of CELLS numbers, which every copy and every text of the plan would hold."""
    words = "sea tone mill paper stone river".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * k) % 6] + str(k) for k in range(60)), "x", 1) for i in range(9)], "doc_id long, text string, ratios string, `a.b` int")
    got = stage(docs, docs.filter("doc_id < 4").select("doc_id"))
    assert got.count() == 9
    assert size_of_plan(got) < 100_000
    if stage is quality.keep:
        assert got.columns == docs.columns


def test_later_rounds_do_not_plan_the_open_columns_anew(spark, monkeypatch):
    """Pivots and both sides of the product are read from what is written down; each way to take them had all the joins of the classes' state."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choice(words, 90)
        for k in range(5):
            own = base.copy()
            own[7 * k : 7 * k + k] = "x"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joins, cut = [], jaccard.cut

    def spied(df):
        if df.columns == ["a", "b"]:
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return cut(df)

    monkeypatch.setattr(jaccard, "cut", spied)
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    wanted = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((wanted[a], wanted[b]))
                wanted = [low if x == high else x for x in wanted]
    assert got == dict(enumerate(wanted)) and len(set(wanted)) < len(wanted)
    assert len(joins) > 1 and max(joins[1:]) <= 5, joins
