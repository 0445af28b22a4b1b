"""op9's score against plain Python over the trained model."""

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vertexmill.llm import lblm, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs():
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(120)] + ["Été", "漢字"]
    for k in range(90):
        yield k, " ".join(words[int(len(words) * x**2)] for x in r.random(int(r.integers(0, 60)))) + (f" only{k}" if k % 3 == 0 else "")
    yield from [(200, None), (201, ""), (None, "w1 w2 W3"), (5, "w1 w1 w1"), (5, "w1 w1 w1")]


def test_score_against_plain_python(spark):
    rows = list(_docs())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lblm.score(docs, most_words=40).collect()
    table = docs.select("doc_id", lblm.held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = lblm.count(table, 40)
    model = lblm.train(table, lblm.first_model(counts), counts.tokens)

    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    tokens = lambda t: [*map(lower, WORD.findall(t or "")), None]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    n = {}
    for i, t in rows:
        for w in tokens(t) if not out(i) else []:
            n[w] = n.get(w, 0) + 1

    def hash_of(w):
        if w is None:
            return lblm.END_HASH
        data = np.frombuffer(w.encode(), np.uint8)
        return text.Words(data, np.array([0, len(data)])).hashes()[0]

    number = {w: int(model.of(np.array([hash_of(w)]))[0]) for w in {x for _, t in rows for x in tokens(t)}}
    vocabulary = {w for w, c in number.items() if c != lblm.OTHER}
    assert 20 < len(vocabulary) <= 42 and any(w in n and w not in vocabulary for w in number)
    # the words outside the vocabulary, and one unseen, share the other words' probability by their counts plus one
    rest = sum(c + 1 for w, c in n.items() if w not in vocabulary) + 1

    def score(t):
        c = np.array([number[w] for w in tokens(t)])
        total = 0.0
        for k, w in enumerate(tokens(t)):
            before = np.array([[c[k - j] if k >= j else lblm.END for j in range(1, lblm.ORDER + 1)]])
            p = lblm.SHARE * math.exp(lblm.log_probabilities(model.params, before, c[k : k + 1])[0]) + (1 - lblm.SHARE) * math.exp(model.log_unigram[c[k]])
            total += math.log10(p) + (math.log10((n.get(w, 0) + 1) / rest) if c[k] == lblm.OTHER else 0.0)
        return total

    want = sorted((str(i), len(tokens(t)), score(t)) for i, t in rows)
    mine = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    smoothed = {w: math.exp(model.log_unigram[c]) * ((n.get(w, 0) + 1) / rest if c == lblm.OTHER else 1) for w, c in number.items()}
    assert all(abs(p * (sum(n.values()) + len(n) + 1) / (n.get(w, 0) + 1) - 1) < 1e-4 for w, p in smoothed.items())  # the counts alone give the base score
    assert [x[:2] for x in mine] == [x[:2] for x in want] and np.allclose([x[2] for x in mine], [x[2] for x in want], rtol=1e-4)


def test_mixture_sums_to_one():
    r = np.random.default_rng(1)
    a, b = (np.log(x / x.sum()) for x in r.random((2, 50)))
    assert abs(np.exp(lblm.mixed(a, b)).sum() - 1) < 1e-12 and (lblm.mixed(a, b) >= b + math.log(1 - lblm.SHARE)).all()
