"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every stage but the last returns the columns of documents. Null texts
count as empty; rows without id are neither trusted, nor linked, nor cut, but
mixed and encoded; repeated rows are judged, cut, served and encoded each, and
as duplicates of one id stay together; ties go to the smaller id. Further
columns, whatever their names, are handed on. An empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vertexmill.llm import bpe, jaccard, mixing, quality, rlz
from vertexmill.llm.common import table, written

#: The tokenizer file of the last stage, the same path on every worker.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram model keep; empty and null texts are too short and go."""
    return quality.keep(docs, quality.trusted(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document of the smallest id; texts without words and rows without id stay."""
    return jaccard.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that a document of smaller id holds; a text may become empty."""
    return rlz.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order and number in which the mix serves them."""
    return mixing.mixed_documents(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per served document: doc_id, n_tokens, and SHA-256 of its ids and of the text decoded from them."""
    return bpe.report(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("BPE round trip", bpe_round_trip),
]
#: SQL has neither the quality model's hashes nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs)
    return docs
