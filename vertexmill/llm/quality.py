"""Quality rules: base rules, and a log-likelihood ratio of hashed n-grams.

Texts are cut into pieces (runs of letters, runs of digits, runs of other
signs); their n-grams are hashed into a fixed number of cells. One multinomial
over the cells is counted on trusted documents, one on the whole corpus. A
document's score is the mean over its n-grams of log(trusted / corpus), the
trusted counts being smoothed toward the corpus; the document is kept when the
score reaches a fixed threshold.

All is done with DataFrame functions. The corpus counts are summed in the map
tasks before the shuffle; the ratios, one a cell (CELLS of them), go to the
tasks as one array, and each text is scored where it stands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, words

CELLS = 1 << 16
ORDERS = (1, 2)
#: The trusted multinomial is fitted on so many labelled documents at most: those of the smallest ids.
MOST_TRUSTED = 20_000
#: Weight of the corpus multinomial in the trusted one, in n-grams a cell.
SMOOTHING = 2.0
THRESHOLD = -0.35
MIN_WORDS = 50
#: Per cent of words in repeated 3-word windows beyond which a document fails.
MOST_REPEATED = 50

NOT_SIGNS = "[^#*$%&|<>]+"


def pieces(text: Column) -> Column:
    """Letters, digits and other signs apart, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z\\x80-\\x{10ffff}]+|[0-9]+|[\\x21-\\x2f\\x3a-\\x60\\x7b-\\x7f]+)"), F.lit(1))


def cells(text: Column, orders=ORDERS, n_cells: int = CELLS) -> Column:
    """The cells of a text's n-grams, for each order in turn.

    A piece has one hash; an n-gram's hash is that of the n-gram without its
    last piece, and of this piece.
    """
    def grams(h):
        def longer(g, n):
            count = F.greatest(F.size(h) - (n - 1), F.lit(0))
            return F.zip_with(F.slice(g, F.lit(1), count), F.slice(h, F.lit(n), count), lambda a, b: F.xxhash64(a, b))

        def of_order(g, n):
            own = [F.transform(g, lambda x: F.pmod(x, F.lit(n_cells)).cast("int"))] if n in orders else []
            if n == max(orders):
                return own
            return own + [let(longer(g, n + 1), lambda more: F.concat(*of_order(more, n + 1)))]

        return F.concat(*of_order(h, 1))

    return let(F.transform(pieces(text), lambda x: F.xxhash64(x)), grams)


#: Low bits of a window's hash that make room for its place, so that numbers can be sorted.
PLACE_BITS = 24


def repeat_words(w: Column) -> Column:
    """Words that stand in 3-word windows found twice or more in the same text.

    The windows' 64-bit hashes are sorted with their places, so that equal ones
    are neighbours: n log n in the length of the text. Hash and place share a
    number; where neighbours differ only in the bits that this costs, or the
    text is too long for it, both are sorted in full.
    """
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")

    def alike(x, y):
        return F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))

    def place(x):
        return x.bitwiseAND(low).cast("int")

    def counted(h):
        def of_sorted(s):
            return let(F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1))), checked)

        def checked(at):
            def clash(x, k):
                y = F.get(at, k - 1)
                return alike(x, y) & (F.get(h, place(x)) != F.get(h, place(y)))

            return F.when(F.size(at) == 0, 0).when(F.exists(F.transform(at, clash), lambda x: x), _repeats_in_full(h)).otherwise(_words_under(F.sort_array(F.transform(at, place))))

        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        return F.when(F.size(h) >= 1 << PLACE_BITS, _repeats_in_full(h)).otherwise(let(F.sort_array(packed), of_sorted))

    def windows(g):
        return F.transform(F.slice(g, F.lit(1), F.greatest(F.size(g) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(g, i + 1), F.get(g, i + 2)))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda g: let(windows(g), counted))


def _repeats_in_full(h: Column) -> Column:
    def repeated(s):
        def again(x, k):
            return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

        return _words_under(F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"])))

    return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)


def _words_under(at: Column) -> Column:
    """How many words the 3-word windows at these sorted places cover."""
    def total(p):
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get(p, k - 1), F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return let(at, total)


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); null texts count as empty."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    return {
        "counts": counts,
        "n_symbols": F.length(F.regexp_replace(plain, NOT_SIGNS, "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def ratios(docs: DataFrame, trusted_ids: DataFrame, orders=ORDERS, n_cells: int = CELLS, smoothing: float = SMOOTHING, most_trusted: int = MOST_TRUSTED) -> list[float]:
    """Of each cell the log of trusted over corpus frequency, counted over all docs; 0 for a cell that no text has.

    trusted_ids(doc_id) names the trusted documents; the `most_trusted` smallest
    are used. With none, or no docs, every ratio is 0. n_cells counts come to
    the driver.
    """
    ids = trusted_ids.select("doc_id").filter("doc_id is not null").distinct().orderBy("doc_id").limit(most_trusted)
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("trusted", F.lit(1))), "doc_id", "left")
    grams = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(cells(F.col("text"), orders, n_cells)).alias("cell"))
    counts = grams.groupBy("cell").agg(F.count("*").alias("n"), F.sum("trusted").alias("t")).collect()
    all_n, all_t, prior = sum(r["n"] for r in counts), sum(r["t"] for r in counts), smoothing * n_cells
    out = [0.0] * n_cells
    for r in counts:
        expected = r["n"] / all_n
        out[r["cell"]] = math.log((r["t"] + prior * expected) / (all_t + prior) / expected)
    return out


def with_ratios(docs: DataFrame, table: list[float], name: str) -> DataFrame:
    """docs with the ratios, to five decimals, as the array column `name`, the same for every row.

    They come from a table of one row by a scalar subquery. As a literal they
    would be spelled out in every copy and every text of the plan on the driver.
    """
    one = docs.sparkSession.createDataFrame([(",".join(f"{x:.5f}" for x in table),)], "ratios string")
    return docs.withColumn(name, one.select(F.split("ratios", ",").cast("array<float>")).scalar())


def likelihood(text: Column, ratio: Column, orders=ORDERS, n_cells: int = CELLS) -> Column:
    """(n_grams, score) of a text: the number of its n-grams and the mean of their ratios, 0 without any."""
    def mean(c):
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(ratio, x))
        return F.struct(F.size(c).cast("long").alias("n_grams"), F.when(F.size(c) > 0, total / F.size(c)).otherwise(0.0).alias("score"))

    return let(cells(text, orders, n_cells), mean)


def judge(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """A row per row of docs: doc_id, the base columns, base_failed, n_grams, score, kept.

    Null texts count as empty: no words, so base_failed. Documents without an
    n-gram score 0; a score equal to the threshold is kept. Repeated rows are
    counted and judged each on its own; null ids are judged but never trusted.
    Other columns of docs are not read. An empty table gives an empty result.
    Rows are neither split nor shuffled.
    """
    docs, base = docs.select("doc_id", "text"), base_columns(F.col("text"))
    docs, model = _modelled(docs, trusted_ids, "ratios", fit)
    rows = docs.select("doc_id", *[c.alias(n) for n, c in base.items()], model.alias("model"))
    counts, score = F.col("counts"), F.col("model.score")
    failed = base_failed(counts)
    return rows.select(
        "doc_id", *[counts[n].cast("long").alias(n) for n in ("n_words", "word_chars")], "n_symbols", "n_dup_lines", counts["n_repeat_words"].cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"), "model.n_grams", score.alias("score"), (~failed & (score >= threshold)).alias("kept"),
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def keep(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever these are called. Nulls, repeats and empty tables as there."""
    text = F.col("text")
    good = let(base_columns(text)["counts"], lambda c: ~base_failed(c))
    name = free_name(docs, "ratios")
    docs, model = _modelled(docs, trusted_ids, name, fit)
    return docs.filter(good).filter(model["score"] >= threshold).drop(name)


def _modelled(docs: DataFrame, trusted_ids: DataFrame, name: str, fit: dict) -> tuple[DataFrame, Column]:
    """docs with the fitted ratios as the column `name`, and the model of a row's text."""
    table = ratios(docs, trusted_ids, **fit)
    return with_ratios(docs, table, name), likelihood(F.col("text"), F.col(name), fit.get("orders", ORDERS), len(table))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that the labels call good and not toxic."""
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")
