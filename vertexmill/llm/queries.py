"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bitplane, bpe, jaccard, lblm, license_scan, mixing, periods, quality, rlz, turns, url_filter, vptree, warc
from .common import table


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return vptree.nearest(vectors, queries)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.report(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), quality.trusted(table(spark, sf_dir, "labels")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(url_filter.RULES), "rule string, verdict string")
    return url_filter.judge(pages, rules, url_filter.feed_urls(pages))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turns.report(turns.damage(conversations), conversations)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(periods.plant(table(spark, sf_dir, "documents")))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_nearest_vectors, op2_substring_dedup, op3_bpe_round_trip, op4_license_scan, op5_quality_rules, op6_url_filter, op7_mix_sources, op8_bit_planes, op9_lm_score, op10_jaccard_join, op11_turn_repair, op12_periodic_runs, op13_warc_round_trip)}
ORACLES: dict[str, str] = {
    "op1_nearest_vectors": """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10""",
    "op6_url_filter": r"""
WITH split AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
feed AS (SELECT DISTINCT host || rtrim(path, '/') AS key FROM split WHERE url LIKE '%utm_source=%' AND host <> ''),
judged AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
         host <> '' AND host || rtrim(path, '/') IN (SELECT key FROM feed) AS listed
  FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged""",
    "op7_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank,
         CAST([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM totals),
-- in the order of size by weight, the level is that of the first source that its own cap does not stop
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3e0 * source_size) OVER (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight DESC, source_rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level
  FROM ranked),
shares AS (
  SELECT source, source_size, source_rank,
         least(3e0 * source_size, weight * (SELECT level FROM filled WHERE 3e0 * source_size > weight * level ORDER BY source_size / weight, source_rank LIMIT 1))::DOUBLE AS target
  FROM filled),
queue AS (
  SELECT doc_id, size, source_rank, source_size, target, epoch, md5(concat_ws('-', CAST(doc_id AS VARCHAR), CAST(epoch AS VARCHAR))) AS draw
  FROM sized JOIN shares ON sized.source IS NOT DISTINCT FROM shares.source, (SELECT unnest([1, 2, 3]) AS epoch)),
timed AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(sum(size) OVER (PARTITION BY source_rank ORDER BY epoch, draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target ELSE 0 END AS finish FROM queue),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM timed)
SELECT doc_id, first(size) AS size, first(source_size) AS source_size, first(target) AS target,
       CAST(sum(greatest(0, least(size, (SELECT sum(source_size) FROM totals) - before))) AS BIGINT) AS taken
FROM served GROUP BY doc_id""",
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words FROM documents),
windows AS (SELECT doc_id, i, hash(words[i:i + 49]) AS h, words[i:i + 49] AS win FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
first AS (SELECT win, min(doc_id) AS ref FROM windows GROUP BY win),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS places FROM windows JOIN first USING (win) WHERE ref < doc_id GROUP BY 1),
kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed, words, places FROM w LEFT JOIN gone USING (doc_id)),
left_over AS (SELECT kept.doc_id, string_agg(words[i], ' ' ORDER BY i) AS text FROM kept, unnest(range(1, len(words) + 1)) AS t(i) WHERE places IS NULL OR NOT list_contains(places, i) GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept LEFT JOIN left_over USING (doc_id)""",
    "op13_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages),
r AS (SELECT *, strlen(html) >= 1000 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS again FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN largest END AS refers_to
FROM r""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS words FROM documents),
sets AS (SELECT doc_id, i, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS shingle FROM w, unnest(range(1, greatest(2, len(words) - 3))) AS t(i) WHERE len(words) > 0),
members AS (SELECT DISTINCT doc_id, shingle FROM sets),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
low AS (SELECT node AS doc_id, min(root) AS root FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)""",
}


def _licence_sql() -> str:
    """Every template's places, share and label, template by template."""
    def quoted(w: str) -> str:
        return "'" + w + "'"

    parts = []
    for t in license_scan.TEMPLATES:
        a, n = t.key
        key = " AND ".join(f"words[i + {p - a}] = {quoted(t.words[p])}" for p in range(a, a + n))
        same = " + ".join(f"CASE WHEN i + {p - a} > 0 AND words[i + {p - a}] = {quoted(w)} THEN 1e0 ELSE 0e0 END" for p, w in enumerate(t.words))
        parts.append(f"SELECT doc_id, {quoted(t.label)} AS label, {str(t.base).lower()} AS base, i - 1 - {a} AS start, ({same}) / {len(t.words)} AS share FROM places WHERE {key}")
    return r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
places AS (SELECT doc_id, i, words FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
found AS (SELECT * FROM (""" + " UNION ALL ".join(parts) + f""") WHERE share >= {license_scan.SHARE})
SELECT w.doc_id, CAST(any_value(len(words)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0e0) AS score
FROM w LEFT JOIN found USING (doc_id) GROUP BY w.doc_id"""


ORACLES["op4_license_scan"] = _licence_sql()
