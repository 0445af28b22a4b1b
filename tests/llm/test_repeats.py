"""The parse against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.llm import rlz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n, vocabulary):
    """Texts with passages that repeat, run over the bounds of blocks, overlap and stand side by side, and exact copies."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [some(rng.randrange(45, 200)) for _ in range(6)] + [some(900)]
    texts = []
    for _ in range(n):
        w = some(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 50))
            w += p[a : a + rng.randrange(40, 400)] + some(rng.randrange(0, 3))
        texts.append(rng.choice(["  ", "\n", " \t"]).join(w))
    texts += [texts[3], texts[5], None, "", " ", "Ü " * 120, "x " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, texts[0]), (7, texts[1]), (7, texts[7]), (7, texts[7]), (9, texts[9])]


def brute(rows, window=50):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 60, [f"w{i}" for i in range(300)] + ["a", "é漢"])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("rlz_cut", "RLZ_ID", "at", "ref", "n_words", "hits")}).withColumn("n_chars", F.length("text")).repartition(4)
    want = brute(rows)
    got = [tuple(r) for r in rlz.report(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(got, key=str) == sorted(((i, n, k, sha(x)) for i, n, k, x in want), key=str) and sum(k > 0 for _, _, k, _ in want) > 30
    kept = rlz.remove_repeats(docs)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str)
    expected = [(i, x if k else t, None if t is None else len(x if k else t)) for (i, t), (_, _, k, x) in zip(rows, want, strict=True)]
    assert texts == sorted(expected, key=str)
    assert rlz.remove_repeats(docs.limit(0)).count() == 0


def test_factors_match_their_references(spark):
    rows = [r for r in corpus(3, 40, [f"w{i}" for i in range(500)]) if r[0] is not None and r[0] not in (7, 9)]
    words = {i: WORD.findall(t or "") for i, t in rows}
    found = rlz.Repeats(spark.createDataFrame(rows, "doc_id long, text string")).factors().collect()
    assert any(r.length > 100 for r in found)
    for r in found:
        own, there = words[r.doc_id][r.start : r.start + r.length], words[r.ref_doc_id][r.ref_start : r.ref_start + r.length]
        assert r.length >= 50 and own == there and r.ref_doc_id < r.doc_id


def test_equal_hashes_of_different_words_are_no_factor():
    words, block = np.arange(80, dtype=np.uint32), np.arange(80, dtype=np.uint32)
    block[30] = 7
    args = (np.array([0, 31]), [(1, 0), (1, 0)], np.array([0, 0]))
    assert rlz.parse(words, *args, {(1, 0, 0): block}, 50) == []
    assert rlz.parse(words, np.array([5]), [(1, 0)], np.array([2]), {(1, 0, 0): np.arange(3, 80, dtype=np.uint32)}, 50) == [(5, 75, 1, 2)]
