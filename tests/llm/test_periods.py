"""Periodic runs against brute force."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from vertexmill.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, least=periods.LEAST_WORDS):
    """Every stretch of equal words q apart, for each q, with the smallest q of each."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def expected(doc_id, text, planted):
    w = WORD.findall(text or "")
    if planted and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(listed), sha(kept), len(w), len(w) - len(gone))


@pytest.mark.parametrize("letters, longest", [(2, 12), (3, 8)])
def test_all_short_words(letters, longest):
    for n in range(1, longest + 1):
        all_ = list(itertools.product(range(letters), repeat=n))
        bounds = np.arange(len(all_) + 1) * n
        start, length, period = periods.find(np.array(all_).ravel(), bounds, least=2)
        text = np.searchsorted(bounds, start, "right") - 1
        got = {}
        for t, *r in zip(text.tolist(), (start - bounds[text]).tolist(), length.tolist(), period.tolist(), strict=True):
            got.setdefault(t, []).append(tuple(r))
        assert [got.get(t, []) for t in range(len(all_))] == [brute(x, 2) for x in all_]


def _texts():
    r = np.random.default_rng(5)
    for _ in range(150):
        w = [f"w{x}" for x in r.integers(0, r.choice([1, 2, 3, 40]) + 1, r.integers(0, 160))]
        if w and r.random() < 0.6:
            a, p = r.integers(len(w)), r.integers(1, len(w) // 2 + 2)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        yield " ".join(w)
    for m, k in ((3, 4), (9, 2), (20, 31)):  # two stretches of one period meet
        yield "a b " * m + "a " + "a b " * k
    yield from (None, "", " \n\t", "one", "é " * 11, "é " * 12, "x\x85y " * 20, "A a " * 30, "word\n" * 50_000, "p q r\x0b" * 7 + "p q s " * 9)


def test_report_against_brute_force(spark):
    rows = list(enumerate(_texts())) + [(3, "again and " * 9), (None, "no id " * 8), (None, None)]
    docs = spark.createDataFrame([(i, t, "source", 1) for i, t in rows], "doc_id long, text string, start string, n_runs int").repartition(3)
    for planted in (False, True):
        got = [tuple(r) for r in periods.report(periods.plant(docs) if planted else docs).collect()]
        assert sorted(got, key=str) == sorted([expected(i, t, planted) for i, t in rows if t is None or len(t) < 100_000] + [r for r in got if r[8] == 50_000], key=str)
        long = [r for r in got if r[8] == 50_000]
        assert len(long) == 1 and long[0][1:6] == (1, 0, 50_000, 1, 50_000_000) and long[0][9] == 1
    listed = sorted(map(tuple, periods.runs(docs).collect()), key=str)
    assert listed == sorted([(i, *r) for i, t in rows for r in ([(0, 50_000, 1)] if t and len(t) > 100_000 else brute(WORD.findall(t or "")))], key=str)
    texts = {r.doc_id: r.text for r in periods.collapse(docs).collect()}
    assert texts[rows[0][0]] is not None and len(texts) == len({i for i, _ in rows})


def test_a_text_over_a_slice(spark):
    from vertexmill.llm import text

    w = [f"w{i}" for i in range(700_000)]
    w[500_000:] = w[400_000:500_000] * 2
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "a b c " * 5)], "doc_id long, text string")
    assert len(" ".join(w)) > text.SLICE_BYTES
    assert sorted(tuple(r)[:6] for r in periods.report(docs).collect()) == [(1, 1, 400_000, 300_000, 100_000, 3000), (2, 1, 0, 15, 3, 5000)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periods.report(periods.plant(empty)).count() == periods.runs(empty).count() == periods.collapse(empty).count() == 0
