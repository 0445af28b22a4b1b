"""Near-duplicate join on n-gram Jaccard similarity, as a blocked sparse matrix product.

Documents are rows, distinct 5-word shingles are columns of a sparse incidence
matrix. The product of the matrix with its transpose holds all overlaps; it is
summed block by block (a block being the columns of one shuffle partition), and
pairs that cannot reach the bound that follows from their sizes are discarded
before the rest of their columns is multiplied:

- Columns are put in one order for all documents, locally frequent shingles
  last, the others by hash. Two sets that reach the threshold share a column
  among the first n - ceil(t * n) + 1 of each (n being its size), so only these
  leading columns enter the first product, and a column counts only if two
  different sets hold it.
- Up to the earlier of two sets' last leading columns the accumulated overlap is
  complete; what lies beyond adds at most the rest of that set, and at most what
  the other has after the last shared column. Pairs for which this stays below
  t / (1 + t) * (a + b) go.
- Each set has parity bits, more for larger sets. The bits in which two sets
  differ number at most what stands in one of them only, so a pair that differs
  in too many is discarded as the last round's blocks are multiplied.
- The surviving pairs' whole rows are multiplied.

Equal sets are one class from the start. As only components are asked for,
pairs inside a component are not multiplied. In a round, the classes of a column
that lies across components are multiplied with the column's pivot only, which
costs a product a row: the pivot is the class that meets most others in its
leading columns, so the text that a group of near copies was made from. Rounds
go on while they link enough; then only pairs across the remaining components
that no round has tested are formed. No link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexmill.operators.components import connected_components
from vertexmill.plans.checkpoints import discard

from . import text as tx
from .common import cut, free_name, written

SHINGLE = 5
PERCENT = 80
#: Shingles that go last in the order of columns: at most so many (8 bytes each are broadcast). Any order gives the same result; this one keeps common columns out of the first product.
MOST_COMMON = 1 << 16
#: Rounds of pivots at most; they end before when a round links fewer than one class in so many of those in open columns.
PIVOT_ROUNDS, LEAST_LINKED = 6, 50
#: Components of classes are joined, and whole sets fetched, by broadcast of up to so many rows (16 bytes each), else by shuffle.
MOST_BROADCAST_KEYS = 200_000
#: Parity bits of sets of up to so many shingles, and of larger ones; multiples of 64, powers of two.
PARITY_BITS = ((256, 512), (512, 1024), (1 << 62, 2048))
#: Bits of a set's size, of a leading column's place, and of the rank of a set's last leading column, in one number.
SIZE_BITS, AT_BITS, LAST_BITS = 26, 24, 13


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; a shorter sequence counts as one."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(tx.windows(hashes, min(k, len(hashes))) + np.uint64(min(k, len(hashes))))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for row, end, w in tx.slices(column, lower=True):
        h = w.hashes()
        for i in range(end - row):
            yield shingles(h[w.first[i] : w.first[i + 1]], k)


def _class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile(k: int):
    """Per document its set's size, class and parity bits (these once a class and batch); per batch the shingles that stand in many of its different sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, label, seen, parts, bits = [], [], set(), [], []
            for s in _sets(batch.column("text"), k):
                size.append(len(s))
                label.append(_class(s))
                bits.append(None)
                if label[-1] not in seen:
                    seen.add(label[-1])
                    parts.append(s)
                    if len(s):
                        bits[-1] = parity(s)
            values, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            common = np.flatnonzero(counts >= max(4, len(parts) / 2000))
            n, m = batch.num_rows, len(common)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, pa.int64())]), pa.concat_arrays([batch.column("row_hash"), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([size, counts[common]]).astype(np.int64)), pa.array(np.concatenate([np.array(label, np.int64), values[common].view(np.int64)])), pa.array([True] * n + [False] * m),
                    pa.array([*bits, *[None] * m], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_hash", "n", "value", "is_doc", "sketch"],
            )

    return run


def leading(size: int, percent: int) -> int:
    """How many columns of a set enter the first product."""
    return size - math.ceil(percent * size / 100) + 1


def ordered(s: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """The n first columns of sorted set s: those outside sorted `common` by hash, then the rest by hash."""
    if not len(common):
        return s[:n]
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~late], s[late]])[:n]


def _rank(last: np.uint64, late: bool) -> int:
    """The place of a column in the order of columns, in LAST_BITS bits."""
    return (int(late) << (LAST_BITS - 1)) | int(last) >> (64 - LAST_BITS + 1)


def parity(s: np.ndarray) -> np.ndarray:
    """Of each of a number of buckets that follows from the set's size, whether an odd number of the set's hashes falls into it, as int64 words."""
    n_bits = next(bits for most, bits in PARITY_BITS if len(s) <= most)
    odd = np.bincount((s & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _lead(k: int, percent: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for batch in batches:
            seen: set[int] = set()
            out: list[tuple[np.ndarray, int, int]] = []
            for s in _sets(batch.column("text"), k):
                if not len(s) or (label := _class(s)) in seen:
                    continue
                if len(s) >> SIZE_BITS:
                    raise ValueError(f"a text has {len(s)} distinct shingles, more than 2 ** {SIZE_BITS}")
                seen.add(label)
                first = ordered(s, late, leading(len(s), percent))
                is_late = len(late) > 0 and late[min(np.searchsorted(late, first[-1]), len(late) - 1)] == first[-1]
                out.append((first, label, len(s) << LAST_BITS | _rank(first[-1], is_late)))
            if not out:
                continue
            counts = np.array([len(x) for x, _, _ in out])
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            size = np.repeat(np.array([n for _, _, n in out], np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x for x, _, _ in out]).view(np.int64)), pa.array(np.repeat(np.array([c for _, c, _ in out], np.int64), counts)), pa.array(size << AT_BITS | at)],
                names=["col", "label", "packed"],
            )

    return run


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(batch.column("text"), k)]
            if sets:
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["label", "cols"])

    return run


def _pairs(x: DataFrame, y: DataFrame, percent: int, apart: bool) -> DataFrame:
    """(a, b, shared): overlaps of x's with y's leading columns, summed by pair; pairs below the bound go.

    x, y: (col, label, size, at, last, component, tested). Pairs of which one has
    tested the other are left out; with apart, where rows have a sketch as well,
    also pairs whose parity bits differ in too many places, pairs inside a
    component, and the second of the two ways to name a pair.
    """
    def side(df, n):
        return df.select("col", *[F.col(c).alias(f"{c}_{n}") for c in ("label", "size", "at", "last", "component", "tested", *(["sketch"] if apart else []))])

    similar = (F.col("label_a") != F.col("label_b")) & (100 * F.col("size_a") >= percent * F.col("size_b")) & (100 * F.col("size_b") >= percent * F.col("size_a"))
    for n, other in (("a", "b"), ("b", "a")):
        similar = similar & ~F.coalesce(F.array_contains(f"tested_{n}", F.col(f"label_{other}")), F.lit(False))
    if apart:
        similar = similar & (F.col("component_a") < F.col("component_b")) & ((100 + percent) * _differ() <= (100 - percent) * (F.col("size_a") + F.col("size_b")))
    both = side(x, "a").join(side(y, "b"), "col").filter(similar)
    first = [F.first(f"{c}_{n}").alias(f"{c}_{n}") for n in "ab" for c in ("size", "last")]
    sums = both.groupBy(F.col("label_a").alias("a"), F.col("label_b").alias("b")).agg(F.count("*").alias("shared"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"), *first)

    def rest(n, other):
        # beyond its last leading column if that comes first, else beyond the last shared one
        size = F.col(f"size_{n}")
        lead = size - F.ceil(percent * size / F.lit(100)) + 1
        return F.when(F.col(f"last_{n}") < F.col(f"last_{other}"), size - lead).otherwise(size - F.col(f"at_{n}") - 1)

    most = F.col("shared") + F.least(rest("a", "b"), rest("b", "a"))
    return sums.filter((100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b"))).select("a", "b", "shared")


def _differ() -> Column:
    """In how many parity bits sketch_a and sketch_b differ; 0 where they are of different lengths."""
    def bits(low, high):
        out = F.lit(0)
        for i in range(low, high):
            out = out + F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i))))
        return out

    words = [n // 64 for _, n in PARITY_BITS]
    out = F.lit(0)
    for n in words:
        out = F.when((F.size("sketch_a") == n) & (F.size("sketch_b") == n), bits(0, n)).otherwise(out)
    return out


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): the pairs' whole overlaps against the threshold."""
    a = sets.select(F.col("label").alias("a"), F.col("cols").alias("cols_a"))
    b = sets.select(F.col("label").alias("b"), F.col("cols").alias("cols_b"))
    overlap = F.size(F.array_intersect("cols_a", "cols_b"))
    linked = 100 * overlap >= percent * (F.size("cols_a") + F.size("cols_b") - overlap)
    return pairs.join(a, "a").join(b, "b").select("a", "b", linked.alias("linked"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(doc_id, row_hash, n_shingles, component_id), a row per row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own
    included. A text without words, or null, has the empty set and no link. A
    row without id has no component and links nothing. Rows of one id are one
    node of the graph, whatever their texts. Other columns of docs are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    profile = cut(rows.mapInArrow(_profile(k), "doc_id long, row_hash long, n long, value long, is_doc boolean, sketch array<bigint>"))
    members = profile.filter("is_doc").select("doc_id", "row_hash", "n", F.col("value").alias("label"))
    late = profile.filter("not is_doc").groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(MOST_COMMON).select("value")
    common = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in late.collect()], np.int64).view(np.uint64)))

    texts = rows.filter("doc_id is not null and text is not null")
    lead = texts.mapInArrow(_lead(k, percent, common), "col long, label long, packed long")
    # one shuffle and one sort by column
    of_col = Window.partitionBy("col").orderBy("label")
    whole = of_col.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = lead.select("*", F.first("label").over(whole).alias("low"), F.last("label").over(whole).alias("high"), F.count("*").over(whole).alias("rows"), F.lag("label").over(of_col).alias("before"))
    packed = cut(seen.filter("low <> high and (before is null or before <> label)").select("col", "label", "packed", F.col("rows").cast("int").alias("rows")))
    # the class that meets most others is the likeliest hub of a group
    weight = packed.groupBy("label").agg(F.sum("rows").alias("weight"))
    sketches = profile.filter("sketch is not null").groupBy(F.col("value").alias("label")).agg(F.first("sketch").alias("sketch"))
    facts = cut(weight)
    n_facts = facts.count()

    def near(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= MOST_BROADCAST_KEYS else df

    mask = lambda bits: F.lit((1 << bits) - 1)
    fields = (F.shiftright("packed", AT_BITS + LAST_BITS).alias("size"), F.col("packed").bitwiseAND(mask(AT_BITS)).alias("at"), F.shiftright("packed", AT_BITS).bitwiseAND(mask(LAST_BITS)).alias("last"))
    cols = packed.select("col", "label", *fields)
    node = members.filter("doc_id is not null and n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"))
    sets, tried, tested, component, n_linked, last = None, None, None, None, 0, False
    for turn in range(pivot_rounds + 1):
        if component is None:
            # every class is its own component, and every column lies across two
            across, kept = cols.join(near(facts, n_facts), "label").withColumn("component", F.col("label")).withColumn("tested", F.lit(None).cast("array<bigint>")), None
        else:
            state = facts.join(near(component, n_linked), "label", "left").withColumn("component", F.coalesce("component", "label"))
            marked = cols.join(near(state.select("label", "component"), n_facts), "label")
            ends = marked.groupBy("col").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("col")
            state = state.drop("component").join(tested, "label", "left")
            # written down: the pivots and both sides of the product are taken from it, and would each plan and run all this anew
            across = kept = written(marked.join(ends, "col").join(near(state, n_facts), "label"))
        last = last or turn == pivot_rounds
        if not last:
            if component is not None:  # later rounds look for hubs among the classes not linked yet
                across = across.filter("component = label")
            first = F.max_by(F.struct("label", "size", "at", "last", "component", "tested"), F.struct("weight", -F.col("label")))
            pivots = across.groupBy("col").agg(first.alias("pivot")).select("col", "pivot.*")
            pairs = _pairs(pivots, across, percent, apart=False)
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
        else:
            across = across.join(sketches.join(near(facts.select("label"), n_facts), "label", "left_semi"), "label")
            pairs = _pairs(across, across, percent, apart=True).select("a", "b")
        pairs = cut(pairs)
        discard(kept)
        wanted = pairs.select(F.col("a").alias("label")).union(pairs.select(F.col("b").alias("label"))).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("label"), "label", "left_anti")
        wanted = cut(wanted.join(node, "label").select("label", F.col("first.doc_id").alias("doc_id"), F.col("first.row_hash").alias("row_hash")))
        n_wanted = wanted.count()
        if n_wanted:
            fetched = cut(texts.join(near(wanted, n_wanted), ["doc_id", "row_hash"]).select("label", "text").mapInArrow(_whole(k), "label long, cols array<long>"))
            sets = fetched if sets is None else sets.union(fetched)
        was = n_linked
        if sets is not None:
            found = cut(_links(pairs, sets, percent))
            tried = found if tried is None else tried.union(found)
            links = tried.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
            component = cut(connected_components(links).select(F.col("node").alias("label"), "component"))
        if last:
            break
        if component is not None:
            # of each class the pivots that it is not linked with, one a round
            tested = cut(tried.filter("not linked").groupBy(F.col("b").alias("label")).agg(F.collect_set("a").alias("tested")))
            n_linked = component.count()
        # few new links: what is left is formed in full
        last = (n_linked - was) * LEAST_LINKED <= n_facts

    # classes to documents: a class, a component and an id are all nodes of one small graph
    placed = members.filter("doc_id is not null and n > 0").select("doc_id", "label").distinct()
    if component is None:
        placed = placed.withColumn("component", F.col("label"))
    else:
        placed = placed.join(component, "label", "left").withColumn("component", F.coalesce("component", "label"))
    placed = _with_ids(cut(placed))
    low = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_id = placed.join(low, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = members.join(by_id, "doc_id", "left")
    return out.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_ids(placed: DataFrame) -> DataFrame:
    """(doc_id, component) with the components of rows of one id put together."""
    twice = placed.groupBy("doc_id").agg(F.min("component").alias("v"), F.max("component").alias("u")).filter("u <> v")
    if twice.isEmpty():
        return placed
    ends = placed.join(twice.select("doc_id", "v"), "doc_id").select(F.col("component").alias("u"), "v")
    joined = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return placed.join(joined, "component", "left").select("doc_id", F.coalesce("joined", "component").alias("component"))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs."""
    return near_duplicates(docs).drop("row_hash")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates: of each component the rows of its smallest id stay; so do rows without words or id.

    Repeated rows of that id stay all; other columns may have any names; an
    empty table stays empty.
    """
    found = near_duplicates(docs)
    gone = free_name(docs, "gone_id")
    ids = found.filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
