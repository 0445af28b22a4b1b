"""Places that only the mandatory phrase proposes."""

import random
import re

from pyspark.sql import functions as F

from vertexmill.llm import license_scan


def test_variants_without_the_rarest_words(spark):
    """60 % or more of each template's words with the key phrase, against brute force; the words left out, all beyond the key, stand in no document and so rank as the rarest."""
    docs, want = [], {}
    for i, t in enumerate(x for x in license_scan.TEMPLATES if not x.base and x.key[1] < len(x.words)):
        a, n = t.key
        beyond = [p for p in range(len(t.words)) if not a <= p < a + n]
        left_out = beyond[-min(len(beyond), int(0.4 * len(t.words))):]
        words = [f"zz{p}" if p in left_out else w for p, w in enumerate(t.words)]
        docs.append((i, "Head " + " ".join(words)))
        want[i] = (t.label, sum(w == x for w, x in zip(words, t.words)) / len(t.words))
    rows = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: (r.labels.split(","), r.score) for r in rows.collect()}
    assert got.keys() == want.keys()
    assert all(label in got[i][0] and got[i][1] >= share - 1e-12 for i, (label, share) in want.items())
    alone = license_scan.template("own", "alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta")
    text = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta x x x x")], "doc_id long, text string")
    assert license_scan.scan(text, (alone, license_scan.template("mit", "mit license"))).first().labels == "own"


def brute(text, templates):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    found = {}
    for t in templates:
        a, n = t.key
        for s in range(-a, len(words) - a - n + 1):
            at = {p: words[s + p] for p in range(len(t.words)) if 0 <= s + p < len(words)}
            share = sum(at.get(p) == w for p, w in enumerate(t.words)) / len(t.words)
            if all(at.get(p) == t.words[p] for p in range(a, a + n)) and share >= license_scan.SHARE:
                found.setdefault(t.label, []).append((s, share))
    base = [s for t in templates if t.base for s, _ in found.get(t.label, [])]
    names = lambda wanted: ",".join(sorted({t.label for t in templates if wanted(t) and t.label in found}))
    return (len(words), len(base), min(base, default=None), max(base, default=None), names(lambda t: t.base), names(lambda t: True), max((x for v in found.values() for _, x in v), default=0.0))


def test_planted_texts_against_brute_force(spark):
    """Every template's text alone, twice, amid other words, cut short and with words changed; odd rows; a very long text."""
    rng = random.Random(4)
    common = sorted({w for t in license_scan.TEMPLATES for w in t.words}) + ["zz", "Ünder", "kü"]
    texts = [None, "", " ", "...", "MIT", "mit license mit license", "MIT-License; cc by\tCC-BY!", "\n\x0bapache   license\n", "MİT license"]
    for t in license_scan.TEMPLATES:
        whole = " ".join(t.words)
        texts += [whole, f"{whole}. {whole.upper()}", " ".join(rng.choices(common, k=20)) + " " + whole + " " + " ".join(rng.choices(common, k=20)), " ".join(t.words[: len(t.words) * 3 // 4])]
        texts.append(" ".join(w if rng.random() < 0.85 else "zz" for w in t.words))
    texts += [" ".join(rng.choices(common, k=200)) for _ in range(20)] + [" ".join(rng.choices(common, k=50_000)) + " gnu general public license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (4, "MIT"), (4, "MIT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("s", "labels", "score", "word", "N_BASE")})
    plan = license_scan.scan(docs, frequencies={})._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Python", "Arrow"))
    got = sorted((tuple(r) for r in license_scan.scan(docs).collect()), key=str)
    want = sorted(((i, *brute(t, license_scan.TEMPLATES)) for i, t in rows), key=str)
    assert [r[:7] for r in got] == [r[:7] for r in want] and all(abs(a[7] - b[7]) < 1e-12 for a, b in zip(got, want, strict=True))
    assert {x for r in want for x in r[6].split(",") if x} == {t.label for t in license_scan.TEMPLATES}
    assert license_scan.scan(docs.limit(0)).count() == 0
