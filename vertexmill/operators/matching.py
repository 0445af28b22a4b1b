"""Feature matching: compatibility of records, mutual nearest neighbours, summary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexmill.plans.checkpoints import written

#: Rows of one image's descriptors that are compared at once.
BLOCK_ROWS = 2000
#: Features of an image that a task holds at once, about; images of more are dealt into blocks.
GROUP_ROWS = 16_384


def check_features(records: DataFrame, mode: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(usable records, rejected with reason): records(image_id, status, extraction_mode, descriptor_source, num_keypoints, keypoints, descriptors, scores).

    Reasons are tried in a fixed order; the first that holds is given.
    """
    width = F.size(F.col("descriptors")[0])
    reason = (
        F.when(~(F.coalesce("extraction_mode", F.lit("unknown")) == mode) | ~(F.coalesce("descriptor_source", F.lit("unknown")) == source), "incompatible feature format")
        .when(~(F.coalesce("status", F.lit("")) == "success"), "extraction did not succeed")
        .when(F.col("keypoints").isNull() | F.col("descriptors").isNull(), "missing keypoints or descriptors")
        .when(F.exists("keypoints", lambda k: F.coalesce(F.size(k), F.lit(0)) < 2), "invalid keypoint shape")
        .when(F.exists("descriptors", lambda d: d.isNull() | (F.size(d) != width)), "invalid descriptor shape")
        .when((F.coalesce("num_keypoints", F.lit(0)) <= 0) | (F.size("keypoints") == 0), "no keypoints")
        .when(F.size("keypoints") != F.size("descriptors"), "keypoints and descriptors differ in number")
        .when(F.col("scores").isNotNull() & (F.size("scores") != F.size("keypoints")), "scores and keypoints differ in number")
    )
    marked = records.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def mutual_best(a: np.ndarray, b: np.ndarray, least: float, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, dot products) of pairs that are each other's best, ties to the lower row, with a product over least. Blocks bound the memory."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    best_a, row_a, _, row_b = _bests(a, b, block)
    rows = np.flatnonzero((row_b[row_a] == np.arange(len(a))) & (best_a > least))
    return rows, row_a[rows], best_a[rows]


def _bests(a: np.ndarray, b: np.ndarray, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The largest product of each row of a, the first row of b that has it, and the same of b."""
    best_b = np.full(len(b), -np.inf)
    row_b = np.zeros(len(b), int)
    best_a = np.full(len(a), -np.inf)
    row_a = np.zeros(len(a), int)
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            s = a[i : i + block] @ b[j : j + block].T
            k = s.argmax(1)
            v = s[np.arange(len(s)), k]
            new = v > best_a[i : i + block]
            best_a[i : i + block][new], row_a[i : i + block][new] = v[new], k[new] + j
            k = s.argmax(0)
            v = s[k, np.arange(s.shape[1])]
            new = v > best_b[j : j + block]
            best_b[j : j + block][new], row_b[j : j + block][new] = v[new], k[new] + i
    return best_a, row_a, best_b, row_b


def match_pairs(features: DataFrame, pairs: DataFrame, min_score: float = 0.1, normalise: bool = False) -> DataFrame:
    """(image_id_a, image_id_b, feature_idx_a, feature_idx_b, match_score): mutual nearest neighbours in descriptor space with a score over min_score.

    features(image_id, feature_idx, descriptor), one row a keypoint; pairs are
    (image_id_a, image_id_b). Each image's features go once to each of its
    pairs; a group holds the features of two images. An image of more than
    GROUP_ROWS features is dealt into blocks, of which a group holds two; the
    best of all blocks is then taken for each feature.
    """
    pairs = pairs.select("image_id_a", "image_id_b").distinct()
    rows = features.filter("descriptor is not null").select("image_id", "feature_idx", "descriptor")
    sizes = written(rows.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("blocks")))
    if sizes.filter("blocks > 1").isEmpty():
        return _matched(rows, pairs, min_score, normalise)
    of = lambda k: sizes.select(F.col("image_id").alias(f"image_id_{k}"), F.col("blocks").alias(f"blocks_{k}"))
    known = written(pairs.join(of("a"), "image_id_a").join(of("b"), "image_id_b"))
    few = _matched(rows, known.filter("blocks_a = 1 and blocks_b = 1").select("image_id_a", "image_id_b"), min_score, normalise)
    return few.union(_matched_by_blocks(rows.join(sizes, "image_id"), known.filter("blocks_a > 1 or blocks_b > 1"), min_score, normalise))


def _descriptors(t: pa.Table, normalise: bool) -> np.ndarray:
    d = t.column("descriptor").combine_chunks()
    m = d.flatten().to_numpy().astype(np.float64).reshape(len(t), -1) if len(t) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if normalise and len(m) else m


def _matched(rows: DataFrame, pairs: DataFrame, min_score: float, normalise: bool) -> DataFrame:
    """match_pairs() of images that a task holds."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("feature_idx"), right.sort_by("feature_idx")
        (ia, a), (ib, b) = ((t.column("feature_idx").to_numpy(), _descriptors(t, normalise)) for t in (left, right))
        if not len(a) or not len(b) or a.shape[1] != b.shape[1]:
            ra, rb, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            ra, rb, s = mutual_best(a, b, min_score)
        n = len(ra)
        return pa.table({"image_id_a": np.full(n, key[0].as_py(), np.int64), "image_id_b": np.full(n, key[1].as_py(), np.int64), "feature_idx_a": ia[ra].astype(np.int64), "feature_idx_b": ib[rb].astype(np.int64), "match_score": s})

    keys = ["image_id_a", "image_id_b"]
    left = pairs.join(rows.withColumnRenamed("image_id", "image_id_a"), "image_id_a")
    right = pairs.select(*[F.col(k).alias(k) for k in keys]).join(rows.select(F.col("image_id").alias("image_id_b"), F.col("feature_idx").alias("feature_idx"), F.col("descriptor").alias("descriptor")), "image_id_b").select(*[F.col(k).alias(k) for k in (*keys, "feature_idx", "descriptor")])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "image_id_a long, image_id_b long, feature_idx_a long, feature_idx_b long, match_score double")


def _matched_by_blocks(rows: DataFrame, pairs: DataFrame, min_score: float, normalise: bool) -> DataFrame:
    """match_pairs() of pairs(image_id_a, image_id_b, blocks_a, blocks_b), rows(..., blocks) being dealt into so many blocks.

    Features of one index are told apart by a hash of their descriptors.
    """
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = [("feature_idx", "ascending"), ("mark", "ascending")]
        left, right = left.sort_by(order), right.sort_by(order)
        a, b = (_descriptors(t, normalise) for t in (left, right))
        ids = [t.column(c).to_numpy().astype(np.int64) for t in (left, right) for c in ("feature_idx", "mark")]
        if not len(a) or not len(b) or a.shape[1] != b.shape[1]:
            of_a, at_a, at_b, s = np.zeros(0, bool), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            best_a, row_a, best_b, row_b = _bests(a, b)
            of_a = np.repeat([True, False], [len(a), len(b)])
            at_a, at_b, s = np.concatenate([np.arange(len(a)), row_b]), np.concatenate([row_a, np.arange(len(b))]), np.concatenate([best_a, best_b])
            good = s > min_score  # a best that is no more than this makes no match, whichever the other's best is
            of_a, at_a, at_b, s = of_a[good], at_a[good], at_b[good], s[good]
        n = len(s)
        return pa.table({"image_id_a": np.full(n, key[0].as_py(), np.int64), "image_id_b": np.full(n, key[1].as_py(), np.int64), "of_a": pa.array(of_a), "feature_idx_a": ids[0][at_a], "mark_a": ids[1][at_a], "feature_idx_b": ids[2][at_b], "mark_b": ids[3][at_b], "match_score": s})

    keys, images = ["image_id_a", "image_id_b", "x", "y"], ["image_id_a", "image_id_b"]
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{k}") - 1))
    met = written(pairs.select(*images, "blocks_b", upto("a").alias("x")).select(*images, "x", upto("b").alias("y")))
    mark = F.xxhash64("descriptor")
    dealt = rows.select("image_id", F.pmod(F.xxhash64("feature_idx"), F.col("blocks")).cast("int").alias("block"), "feature_idx", mark.alias("mark"), "descriptor")
    side = lambda k, at: met.join(dealt.select(F.col("image_id").alias(f"image_id_{k}"), F.col("block").alias(at), *[F.col(c).alias(c) for c in ("feature_idx", "mark", "descriptor")]), [f"image_id_{k}", at]).select(*[F.col(c).alias(c) for c in (*keys, "feature_idx", "mark", "descriptor")])
    found = side("a", "x").groupBy(*keys).cogroup(side("b", "y").groupBy(*keys)).applyInArrow(run, "image_id_a long, image_id_b long, of_a boolean, feature_idx_a long, mark_a long, feature_idx_b long, mark_b long, match_score double")
    found = written(found)

    def best(own: str, other: str) -> DataFrame:
        """Each feature's best, ties to the smaller of the others."""
        ends = [f"feature_idx_{other}", f"mark_{other}"]
        first = F.min(F.struct((-F.col("match_score")).alias("less"), *ends)).alias("best")
        mine = found.filter("of_a" if own == "a" else "not of_a").groupBy(*images, f"feature_idx_{own}", f"mark_{own}").agg(first)
        return mine.select(*images, f"feature_idx_{own}", f"mark_{own}", *[F.col(f"best.{e}").alias(e) for e in ends], *([(-F.col("best.less")).alias("match_score")] if own == "a" else []))

    both = best("a", "b").join(best("b", "a"), [*images, "feature_idx_a", "mark_a", "feature_idx_b", "mark_b"])
    return both.select(*images, "feature_idx_a", "feature_idx_b", "match_score")


def pair_outcomes(pairs: DataFrame, usable: DataFrame, rejected: DataFrame, matches: DataFrame) -> DataFrame:
    """pairs with outcome (matched, missing_features, incompatible_features), reason and num_raw_matches."""
    ok = usable.select("image_id", F.lit(True).alias("ok"))
    bad = rejected.select("image_id", F.lit(False).alias("ok"), "reason")
    known = ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    side = lambda n: known.select(F.col("image_id").alias(f"image_id_{n}"), F.col("ok").alias(f"ok_{n}"), F.col("reason").alias(f"reason_{n}"))
    counts = matches.groupBy("image_id_a", "image_id_b").agg(F.count("*").alias("num_raw_matches"))
    both = pairs.join(side("a"), "image_id_a", "left").join(side("b"), "image_id_b", "left").join(counts, ["image_id_a", "image_id_b"], "left")
    outcome = F.when(F.col("ok_a").isNull() | F.col("ok_b").isNull(), "missing_features").when(~F.col("ok_a") | ~F.col("ok_b"), "incompatible_features").otherwise("matched")
    out = both.withColumns({"outcome": outcome, "reason": F.coalesce("reason_a", "reason_b"), "num_raw_matches": F.coalesce("num_raw_matches", F.lit(0).cast("long"))})
    return out.drop("ok_a", "ok_b", "reason_a", "reason_b")


def match_summary(outcomes: DataFrame) -> DataFrame:
    """One row about pair_outcomes(): pairs by outcome, raw matches in all, a pair's least, median and most, the first three reasons in pair order."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    raw = F.when(F.col("outcome") == "matched", F.col("num_raw_matches"))
    numbers = outcomes.agg(
        n("matched").alias("matched_pairs"), n("missing_features", "incompatible_features").alias("skipped_pairs"), n("match_failed").alias("failed_pairs"), F.coalesce(F.sum(raw), F.lit(0)).alias("raw_matches"),
        F.coalesce(F.min(raw), F.lit(0)).alias("min_matches"), F.coalesce(F.floor(F.median(raw)), F.lit(0)).alias("median_matches"), F.coalesce(F.max(raw), F.lit(0)).alias("max_matches"),
    )
    first = outcomes.filter("reason is not null").groupBy("reason").agg(F.min(F.struct("image_id_a", "image_id_b")).alias("at")).orderBy("at").limit(3)
    reasons = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return numbers.crossJoin(reasons)
