"""URL filter: a blocked Bloom filter before an exact hash join.

A list holds rules (a host with its subdomains and the start of a path) and
canonical URLs. A page's keys are its canonical URL and every pair of a suffix
of its host, at most as many labels long as a rule's host, and a start of its
path, as long as a rule's path. All listed keys are put in a Bloom filter of
512-bit blocks; a key sets one bit in each of its block's 8 words. Keys that
the filter passes are looked up by an exact join, which removes its false
positives.

The filter is broadcast; it has MOST_BLOCKS blocks at most, so that a longer
list makes it pass more keys, never fewer. Rules are few (one row each) and
broadcast up to MOST_RULES; listed URLs are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

KEYS_A_BLOCK = 32
MOST_BLOCKS = 1 << 16
MOST_RULES = 10_000
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"

#: The query's rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without slashes at the end; null for a URL without host."""
    return F.when(host != "", F.concat(host, F.rtrim(path, F.lit("/"))))


def _places(key: Column, n_blocks: int) -> list[Column]:
    """The key's block, and its bit in each of the block's words."""
    bits = F.xxhash64(F.lit(1), key)
    return [F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("block"), *[F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int").alias(f"b{j}") for j in range(8)]]


def bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of keys(key): (block, w0 ... w7), a row for each block in use."""
    placed = keys.select(*_places(F.col("key"), n_blocks))
    words = [F.expr(f"bit_or(shiftleft(1L, b{j}))").alias(f"w{j}") for j in range(8)]
    return placed.groupBy("block").agg(*words)


def passed(probes: DataFrame, filter_: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of probes(key, ...) that the filter passes."""
    columns = probes.columns
    placed = probes.select(*columns, *_places(F.col("key"), n_blocks))
    hit = F.expr(" AND ".join(f"(shiftrightunsigned(w{j}, b{j}) & 1L) = 1L" for j in range(8)))
    return placed.join(F.broadcast(filter_), "block").filter(hit).select(*columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """A row per row of pages(page_id, url): page_id, host, path, rule, verdict, listed.

    rules(rule, verdict): a rule is a host, then a path from its first slash
    on; the longest that fits wins. listed(url): a page whose canonical URL is
    listed is blocked where no rule fits, others are allowed. A null url, or
    one without "://", has an empty host and path, fits nothing and is allowed.
    Repeated rows, in pages or in a list, are judged alike and change nothing;
    null rules and listed urls are ignored; of two verdicts for one rule the
    smaller counts. Other columns are not read. Empty lists allow all; empty
    pages give an empty result.
    """
    base = cut(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id()))
    rule_host = F.substring_index("rule", "/", 1)
    rules = cut(rules.filter(F.col("rule").contains("/")).groupBy("rule").agg(F.min("verdict").alias("verdict")).select(
        "rule", "verdict", F.size(F.split(rule_host, "[.]", -1)).alias("labels"), (F.length("rule") - F.length(rule_host)).alias("path_length")))
    urls = listed.filter("url is not null").select(canonical(host(F.col("url")), path(F.col("url"))).alias("key")).filter("key is not null").distinct()
    urls = cut(urls)
    shape = rules.agg(F.max("labels"), F.collect_set("path_length"), F.count("*")).first()
    labels, lengths, n_rules = shape[0] or 0, sorted(shape[1]), shape[2]

    n_keys = n_rules + urls.count()
    n_blocks = max(1, min(most_blocks, 1 << max(0, (n_keys // KEYS_A_BLOCK).bit_length())))
    # keys of rules and of URLs are told apart by their first letter
    keys = rules.select(F.concat(F.lit("r"), "rule").alias("key")).union(urls.select(F.concat(F.lit("u"), "key").alias("key")))
    filter_ = bloom(keys, n_blocks)

    parts = F.split("host", "[.]", -1)
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in range(1, labels + 1)]
    starts = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    made = [F.concat(F.lit("r"), s, p) for s in suffixes for p in starts] + [F.concat(F.lit("u"), canonical(F.col("host"), F.col("path")))]
    probes = base.filter("host <> ''").select("row", F.explode(F.array_compact(F.array(*made))).alias("key"))
    maybe = passed(probes, filter_, n_blocks).select("row", F.substring("key", 1, 1).alias("kind"), F.expr("substring(key, 2)").alias("key"))

    small = F.broadcast(rules) if n_rules <= MOST_RULES else rules
    fits = maybe.filter("kind = 'r'").join(small, F.col("key") == F.col("rule")).select("row", "rule", "verdict", F.lit(False).alias("listed"))
    exact = maybe.filter("kind = 'u'").join(urls, "key").select("row", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("listed"))
    order = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule"))
    found = fits.union(exact).groupBy("row").agg(F.max_by("rule", order).alias("rule"), F.max_by("verdict", order).alias("verdict"), F.max("listed").alias("listed"))
    is_listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("verdict", F.when(is_listed, "block").otherwise("allow"))
    return base.join(found, "row", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), is_listed.alias("listed"))


def feed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: URLs that a feed's tracking parameter marks as syndicated. Null URLs are not listed, repeated ones each; an empty table gives none."""
    return pages.filter(F.col("url").contains("utm_source=")).select("url")
