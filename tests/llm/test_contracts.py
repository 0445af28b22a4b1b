"""Every column of op3, op5, op8 and op9 that plain Python or the tokenizers library can tell."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vertexmill.llm import bitplane, bpe, lblm, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "Hello  world\n\n\tof   words ", "it's <|endoftext|> the end<|endoftext|>", "Ünïcode  漢字 😀　x\x85y\xa0z", "12345 6,7. don't WE'LL 've", "a" * 300,
    "one two three four\n" * 30, "# $ % one\n\n# $ % one\nlast", "\r\n \x0b w \x0c", " ".join(f"w{i % 37}" for i in range(120)), "x y x y x y z " * 3 + "tail",
    " ".join(f"v{i}" for i in range(90)) + "\n | < > & *",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "no id here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_op3_against_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, want = Tokenizer.from_file(path), []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.report(docs, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op8_against_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ROWS]
    rows = bitplane.read_ids(bitplane.write_ids(docs, path, 1)).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    rows = sorted(bitplane.report(docs, path, end_id=1).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    crc = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4"))) for i, x in want)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == crc


def test_op5_base_columns(spark, docs):
    def expected(i, t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = len({k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)})
        failed = len(w) < quality.MIN_WORDS or 100 * again > quality.MOST_REPEATED * len(w)
        return i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, failed, not failed

    none = spark.createDataFrame([], "doc_id long")  # without trusted documents every score is 0 and the base rules decide
    rows = quality.judge(docs, none).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [expected(*r) for r in ROWS]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str) and {r[-1] for r in want} == {True, False}


def test_op9_base_score(docs):
    def tokens(t):
        return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [0]

    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in ROWS]
    n = Counter(w for (_, t), o in zip(ROWS, out, strict=True) if not o for w in tokens(t))
    total = math.log10(n.total() + len(n) + 1)
    want = [(i, o, len(tokens(t)), sum(w in n for w in tokens(t)), n.total(), sum(math.log10(n[w] + 1) - total for w in tokens(t))) for (i, t), o in zip(ROWS, out, strict=True)]
    got = [tuple(r) for r in lblm.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
    got, want = (sorted(x, key=lambda r: str(r[:3])) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(abs(a[5] - b[5]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert any(out)
