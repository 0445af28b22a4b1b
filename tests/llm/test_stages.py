"""The pipeline's stages and the operators on odd tables: nulls anywhere, empty and very long texts, repeated rows, empty tables, extra columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vertexmill.llm import bitplane, bpe, jaccard, lblm, license_scan, mixing, quality

A = " ".join(f"w{i}" for i in range(80))
LONG = " ".join(f"t{i % 977}" for i in range(40_000))
ROWS = [(0, A, "en", "s", 1), (1, A + " z", None, "s", None), (2, A, "en", None, 3), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (5, "one two", "de", "b", 7), (None, A, "en", "s", 1), (None, None, None, None, None), (8, LONG, "en", "c", 9), (9, "a" * 100_000, "en", "c", 9)]
CLASHES = ("mix_hash", "MIX_NTH", "mix_taken", "gone_id", "rlz_cut", "row_hash", "label", "size", "cell", "kept", "score", "draw", "epoch", "slot", "row", "hash", "deal", "finish", "target", "component_id")


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(0, 1, 0), (None, None, None), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str)


def test_quality_stage(spark, docs, folder):
    out = corpus_pipeline.quality_rules(spark, docs, folder)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in quality.judge(docs, quality.trusted(spark.read.parquet(f"{folder}/labels.parquet"))).filter("kept").collect()}
    assert rows(out) == sorted((r[:4] for r in ROWS if r[0] in kept and len((r[1] or "").split()) >= 50), key=str)
    assert all(r.score == c for r in out.collect() for c in ("score",))


def test_jaccard_stage(spark, docs, folder):
    out = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns and rows(out) == sorted((r[:4] for r in ROWS if r[0] not in (1, 2)), key=str)


def test_repeats_stage(spark, docs, folder):
    out = corpus_pipeline.substring_dedup(spark, docs, folder)
    want = [(i, {1: "z", 2: ""}.get(i, t), *r) for i, t, *r in (x[:4] for x in ROWS)]
    assert out.columns == docs.columns and rows(out) == sorted(want, key=str)


def test_mixing_stage(spark, docs, folder):
    out = corpus_pipeline.mix_sources(spark, docs, folder).collect()
    sizes = [len((r[1] or "").split()) for r in ROWS]
    assert sum(len(r.text.split()) for r in out) == sum(sizes)
    assert all(any(r.doc_id == x[0] and r.source == x[3] and (x[1] or "").split()[: len(r.text.split())] == r.text.split() for x in ROWS) for r in out)
    taken = mixing.mix_report(docs).collect()
    assert len(taken) == len(ROWS) and sum(r.taken for r in taken) == sum(sizes) and all(0 <= r.taken <= 3 * r.size for r in taken)
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, taken)) == sorted(map(str, again))


def test_bpe_stage(spark, docs, folder):
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = []
    for i, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in corpus_pipeline.bpe_round_trip(spark, docs, folder).collect()), key=str) == sorted(want, key=str)
    encoded = bpe.encode(docs, corpus_pipeline.TOKENIZER)
    back = bpe.decode(encoded, corpus_pipeline.TOKENIZER)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r[0], r[1] or "") for r in ROWS), key=str)


def test_empty_tables(spark, docs, folder):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    for run in (license_scan.scan, lblm.score, jaccard.components, mixing.mix_report, lambda d: quality.judge(d, d.select("doc_id")), lambda d: bitplane.report(d, corpus_pipeline.TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k"), end_id=1)):
        assert run(none).count() == 0


def test_few_kept_words(docs, monkeypatch):
    """A worker that starts afresh at every batch encodes alike."""
    v = bpe.Vocabulary(corpus_pipeline.TOKENIZER)
    texts = [r[1] or "" for r in ROWS]
    whole, first = v.encode(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    parts = [v.encode([t])[0].tolist() for t in texts]
    assert [whole[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == parts


def test_scores_do_not_depend_on_partitions(docs):
    one, two = (sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), r.score) for r in lblm.score(docs.repartition(n), most_words=50).collect()) for n in (2, 5))
    assert [r[:3] for r in one] == [r[:3] for r in two] and all(abs(a[3] - b[3]) <= 1e-6 * abs(a[3]) for a, b in zip(one, two, strict=True))
