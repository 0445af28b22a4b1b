"""Odd tables through single operators: empty, repeated, very long, with clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vertexmill.llm import bitplane, bpe, rlz, url_filter


def _long_text(n):
    r = np.random.default_rng(8)
    return " ".join(f"w{x}" for x in r.integers(0, 5000, n))


def test_url_filter(spark):
    long = "http://www.example.net/en/" + "a/" * 60_000
    urls = ["http://Example.NET/en/x?utm_source=a", "https://b.net/", "ftp://x.org/fr/q#f", "HTTP://X.ORG/de", "no scheme", "", None, "://", "http:///path", long, "http://b.net/", "x://h.com/p/?utm_source=f", "y://h.com/p", "x://h.com:80/p", "http://notexample.com/de/", "http://a.b.example.com/de/z"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(1, urls[1]), (None, "http://h.com/p//")]
    pages = spark.createDataFrame([(*r, "h", "p", "l") for r in rows], "page_id long, url string, host string, path string, listed string").repartition(3)
    rules = spark.createDataFrame([*url_filter.RULES, *url_filter.RULES, (None, "block"), ("net/", "zap")], "rule string, verdict string")
    listed = url_filter.feed_urls(pages)
    got = [tuple(r) for r in url_filter.judge(pages, rules, listed.union(listed).union(spark.createDataFrame([(None,)], "url string"))).collect()]

    def expected(i, url):
        head, found, rest = (url or "").partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = (rest[:cut].lower(), rest[cut:]) if found else ("", "")
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        key = lambda h, p: h + p.rstrip("/")
        feeds = {key("example.net", "/en/x"), key("h.com", "/p")}
        known = host != "" and key(host, path) in feeds
        return i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "block" if known else "allow", known

    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    empty_rules, empty_list = rules.limit(0), listed.limit(0)
    assert {r.verdict for r in url_filter.judge(pages, empty_rules, empty_list).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0


def test_long_texts_in_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = _long_text(900_000)
    assert len(text) > bpe.BATCH_BYTES
    docs = spark.createDataFrame([(1, text, 1), (2, "short", 2)], "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(path)
    ids = library.encode(text, add_special_tokens=False).ids
    row = {r.doc_id: r for r in bpe.report(docs, path).collect()}[1]
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.report(docs.limit(0), path).count() == 0


def test_long_texts_and_clashing_names_in_bit_planes(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = _long_text(200_000)
    docs = spark.createDataFrame([(7, text, "a", 1), (3, None, "b", 2), (9, "x y", "c", 3)], "doc_id long, text string, row_hash string, start int")
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
    rows = {r.doc_id: r for r in bitplane.report(docs, path, end_id=1).collect()}
    assert rows[7].n_tokens == len(ids) > bitplane.BLOCK_IDS and rows[7].ids_crc32 == zlib.crc32(np.array(ids, "<u4")) and [rows[k].start for k in (3, 7, 9)] == [0, 1, 1 + len(ids)]
    assert bitplane.report(docs.limit(0), path, end_id=1).count() == 0


def test_long_texts_in_the_parse(spark):
    text = _long_text(120_000)
    words = text.split()
    second = " ".join(["new", *words[1000:90_000], "end", *words[:60]])
    docs = spark.createDataFrame([(1, text), (2, second)], "doc_id long, text string").withColumn("shared", F.lit(1))
    rows = {r.doc_id: r for r in rlz.report(docs).collect()}
    assert (rows[1].n_removed, rows[2].n_removed) == (0, 89_060)
    assert rows[2].kept_sha256 == hashlib.sha256(b"new end").hexdigest()
