"""The corpus operators against plain Python on small tables, with odd rows."""

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexmill.llm import bitplane, jaccard, license_scan, lblm, mixing, quality, rlz, url_filter, vptree
from vertexmill.llm import text as tx

WORD = r"[^\x20\x09-\x0D]+"
A = " ".join(f"w{i}" for i in range(80))
DOCS = [(0, A), (1, "x y " + A + " z"), (2, A), (3, None), (4, ""), (5, "one two"), (5, "one two"), (6, "One  two\n"), (7, " ".join(f"v{i}" for i in range(30))), (None, A), (8, "a" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use inside
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"source": F.lit("s"), "n_words": F.lit(-1), "row_hash": F.lit("?"), "label": F.lit(0)})


def test_repeats(docs):
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in rlz.report(docs).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[0, 80] == (0, sha(A)) and got[2, 80] == (80, sha("")) and got[1, 83] == (80, sha("x y z")) and got[3, 0] == (0, sha("")) and got[None, 80] == (0, sha(A))
    assert rlz.report(docs).count() == len(DOCS) and rlz.report(docs.limit(0)).count() == 0


def test_jaccard(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    assert got[0] == (76, 0) and got[1] == (79, 0) and got[2] == (76, 0) and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (1, 5) and got[6] == (1, 5) and got[7] == (26, 7) and got[None][1] is None
    assert jaccard.components(docs).count() == len(DOCS) and jaccard.components(docs.limit(0)).count() == 0


def test_jaccard_groups(spark):
    """Brute force over a large group of near copies around the threshold, many of them not linked."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, 7)):
            w[at] = f"e{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"{x}{rng.integers(0, 3)}" for x in "abcdefgh") for _ in range(50)]
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    low = list(range(len(sets)))
    for _ in sets:
        was = list(low)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
        if low == was:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert got == dict(enumerate(low)) and 20 < len(set(low)) < 190


@pytest.mark.parametrize("texts", [[None, "", None], ["ab " * (5 << 18), None], ["ab " * (5 << 18), "", "ab " * (5 << 18)]])
def test_slices_without_bytes(texts):
    """Null and empty texts alone, after and between texts longer than a slice."""
    got = []
    for row, end, w in tx.slices(pa.array(texts, pa.string())):
        assert row == len(got) and len(w.hashes()) == len(w)
        got += np.diff(w.first).tolist()
    assert got == [len((t or "").split()) for t in texts]


def test_tables_without_bytes(spark):
    none = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", None])], "doc_id long, text string").coalesce(1)
    sha = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rlz.report(none).collect()) == [(i, 0, 0, sha) for i in range(3)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(none).collect()) == [(i, 0, i) for i in range(3)]
    assert sorted((r.doc_id, r.n_tokens) for r in lblm.score(none).collect()) == [(i, 1) for i in range(3)]


def test_base_rules(docs, spark):
    rows = quality.judge(docs, spark.createDataFrame([(0,)], "doc_id long")).collect()
    assert len(rows) == len(DOCS)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == 0 and by[3].base_failed and by[0].n_words == 80 and not by[0].base_failed


def test_mix_shares(docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(DOCS) and sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_licences(spark):
    t = spark.createDataFrame([(1, "MIT License. CC-BY"), (2, None), (3, "apache licenses")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(t).collect()}
    assert got == {1: (4, 2, 0, 2, "cc-by,mit"), 2: (0, 0, None, None, ""), 3: (2, 0, None, None, "")}


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x"), (2, "http://net"), (3, None), (4, "http://B.Org/fr/?q"), (5, "http://c.io/p/")], "page_id long, url string")
    rules = spark.createDataFrame(list(url_filter.RULES), "rule string, verdict string")
    listed = spark.createDataFrame([("https://c.io/p",)], "url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, listed).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("org/fr/", "allow"), 5: (None, "block")}


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vptree.nearest(df, df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), shard_rows=150, leaf=8).collect()
    for q in (0, 100, 200, 300):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    out = io.BytesIO()
    writer = bitplane.PlaneWriter(out, kind, block=100)
    docs = [np.random.default_rng(i).integers(0, 60000, i * 37 % 250).astype(np.uint32) for i in range(20)]
    for i, x in enumerate(docs):
        writer.add(i or None, x)
    writer.close()
    assert all(np.array_equal(a, b) for (_, a), b in zip(bitplane.PlaneReader(out).documents(), docs, strict=True))


def test_model_is_normalised():
    p = lblm.start(np.log(np.full(20, 0.05)))
    before = np.array([[3, 4]] * 20)
    assert abs(np.exp(lblm.log_probabilities(p, before, np.arange(20))).sum() - 1) < 1e-6


def test_scores(docs):
    rows = lblm.score(docs).collect()
    assert len(rows) == len(DOCS)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_tokens == 1 and by[0].n_tokens == len(re.findall(WORD, A)) + 1
