"""The corpus pipeline against plain Python and the tokenizers library on a small corpus."""

import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vertexmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECE = re.compile(r"[a-z\x80-\U0010ffff]+|[0-9]+|[\x21-\x2f\x3a-\x60\x7b-\x7f]+")


def corpus():
    rng = np.random.default_rng(3)
    prose, junk = [f"{a}{b}" for a in ("sea", "Ton", "mil", "ür", "pa") for b in "abcdefghijklmnopqrst"], [f"{s}{n}" for s in "#$%|" for n in range(9)]
    passage = " ".join(rng.choice(prose, 70))
    texts = [" ".join(rng.choice(prose, rng.integers(40, 160))) for _ in range(30)]
    texts += [t.replace("seaa", "seab", 1) + " end" for t in texts[:6]]  # near copies
    texts += [" ".join([*rng.choice(prose, 60), passage, *rng.choice(prose, 90)]) for _ in range(4)]
    texts += [" ".join(rng.choice(junk, 80)) for _ in range(8)] + ["one two three " * 40, "few words 😀😀", "", None]
    texts += [" ".join(rng.choice(prose, 4000)) + "  \n"]
    docs = [(i, t, ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 25 or i == 46), int(i in (3, 4))) for i in range(0, len(docs), 2)]
    return docs, labels


def cells(text):
    one = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in PIECE.findall((text or "").lower())]
    two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(one, one[1:])]
    return [h % quality.CELLS for h in one + two]


def good_quality(docs, labels):
    """(rows that stay, their scores)"""
    trusted = {i for i, good, toxic in labels if good and not toxic}
    n, t = Counter(), Counter()
    for i, text, *_ in docs:
        n.update(cells(text))
        if i in trusted:
            t.update(cells(text))
    all_n, all_t, prior = n.total(), t.total(), quality.SMOOTHING * quality.CELLS
    ratio = {c: math.log((t[c] + prior * n[c] / all_n) / (all_t + prior) / (n[c] / all_n)) for c in n}
    stay, scores = [], {}
    for row in docs:
        w, c = WORD.findall(row[1] or ""), cells(row[1])
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        scores[row[0]] = sum(ratio[x] for x in c) / len(c) if c else 0.0
        if len(w) >= quality.MIN_WORDS and 100 * len(again) <= quality.MOST_REPEATED * len(w) and scores[row[0]] >= quality.THRESHOLD:
            stay.append(row)
    return stay, scores


def first_of_alike(docs):
    words = [WORD.findall(t.lower()) for _, t, *_ in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    low = [r[0] for r in docs]
    for _ in docs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    return [r for r, c in zip(docs, low, strict=True) if r[0] == c]


def without_repeats(docs):
    out, seen = [], set()
    for i, text, source, _ in sorted(docs):
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + j for k, x in enumerate(windows) if x in seen for j in range(50)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text, source))
        seen.update(windows)
    return out


def mixed(docs):
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight = {s: float(k % 3 + 1) for k, s in enumerate(sources)}
    budget, capped = sum(total.values()), set()
    while True:
        level = (budget - sum(3.0 * total[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and 3.0 * total[s] <= weight[s] * level}
        if not more:
            break
        capped |= more
    target = {s: min(3.0 * total[s], weight[s] * level) for s in sources}
    queue = []
    for k, s in enumerate(sources):
        done = 0
        own = [(e, hashlib.md5(f"{i}-{e}".encode()).hexdigest(), i, t) for i, t, x in docs if x == s for e in (1, 2, 3)]
        for _, draw, i, t in sorted(own):
            done += size[i]
            queue.append((done / target[s], k, draw, i, t))
    out = []
    for *_, i, t in sorted(queue):
        taken = min(size[i], budget)
        budget -= taken
        if taken:
            out.append((i, t if taken == size[i] else " ".join(WORD.findall(t)[:taken])))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, (docs, labels) = str(tmp_path_factory.mktemp("corpus")), corpus()
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").withColumn("lang", F.lit("x")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, labels


def test_quality_against_plain_python(spark, tables):
    folder, docs, labels = tables
    table = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(c) for c in ("cell", "counts", "model", "score", "kept", "N_WORDS")})
    trusted = quality.trusted(spark.read.parquet(f"{folder}/labels.parquet"))
    stay, scores = good_quality(docs, labels)
    judged = quality.judge(table, trusted)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Python", "Arrow"))
    rows = judged.collect()
    assert {r.doc_id for r in rows if r.kept} == {r[0] for r in stay} and len(rows) == len(docs)
    texts = {i: t for i, t, *_ in docs}
    assert all(abs(r.score - scores[r.doc_id]) < 1e-5 and r.n_grams == len(cells(texts[r.doc_id])) for r in rows)
    kept = quality.keep(table, trusted)
    assert kept.columns == table.columns and sorted((r.doc_id, r.text, r.score) for r in kept.collect()) == sorted((i, t, "score") for i, t, *_ in stay)
    none = table.limit(0)
    assert quality.judge(none, trusted).count() == quality.keep(none, trusted).count() == 0


def test_repeats_in_full(spark):
    """Both ways of counting repeated windows agree."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in (0, 1, 2, 3, 4, 9, 60, 300)] + ["a " * 50, "a b " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    h = F.transform(quality.words(F.col("text")), lambda x: F.xxhash64(x))
    three = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    rows = df.select("text", quality.repeat_words(quality.words(F.col("text"))).alias("a"), quality._repeats_in_full(three).alias("b")).collect()
    for r in rows:
        w = r.text.split()
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert r.a == r.b == len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_pipeline(spark, tables):
    folder, docs, labels = tables
    judged = good_quality(docs, labels)[0]
    apart = first_of_alike(judged)
    cut = without_repeats(apart)
    served = mixed(cut)
    # every stage has something to do
    assert len(docs) > len(judged) > len(apart) and [t for _, t, *_ in apart] != [t for _, t, _ in cut] and len({i for i, _ in served}) < len(served)
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = []
    for i, text in served:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
