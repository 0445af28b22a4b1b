"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt into shards by hash; each shard's tree splits its vectors at
the median distance to a vantage point, the one of a few candidates to which
distances spread most, down to small leaves. A block of queries goes down a tree
together. A subtree is left out for a query when the triangle inequality, times
a factor, says that it holds nothing nearer than the query's current k-th
neighbour: with factor 1 nothing is lost, a larger factor leaves out more.

Each vector is sent to its shard and each query to every shard. In a shard's
task the vectors come first; their tree is built once, and the queries stream
past it, a batch at a time. Shards hold SHARD_ROWS vectors, about, whatever the
size of the tables. Only distances that were measured on the original vectors
in double precision are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

NEIGHBOURS = 10
FACTOR = 1.0
SHARD_ROWS = 8192
LEAF = 128
#: Candidates for a vantage point, and vectors to which their distances are measured.
CANDIDATES, MEASURED = 8, 64


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite parts, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


class Tree:
    """A vantage-point tree over the rows of points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        centre = self._vantage(rows)
        rest = rows[rows != centre]
        d = np.sqrt(((self.points[rest] - self.points[centre]) ** 2).sum(1))
        radius = float(np.median(d))
        inner, outer = rest[d <= radius], rest[d > radius]
        if not len(outer):  # more than half of the vectors are alike, or equally far
            return rows
        return np.array([centre]), radius, self._build(inner), self._build(outer)

    def _vantage(self, rows: np.ndarray) -> int:
        """Of evenly picked candidates the one whose distances to evenly picked vectors vary most."""
        pick = lambda n: rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(np.int64)]
        candidates, others = pick(CANDIDATES), self.points[pick(MEASURED)]
        spread = [np.sqrt(((others - self.points[c]) ** 2).sum(1)).var() for c in candidates]
        return int(candidates[int(np.argmax(spread))])

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances), k a query, nearest first, ties to the smaller id; -1 and inf where there are fewer. own: the id that a query must not find."""
        n = len(queries)
        best = np.full((n, k), np.inf)
        rows = np.full((n, k), -1)
        stack = [(self.root, np.arange(n), np.zeros(n))]
        while stack:
            node, who, least = stack.pop()
            alive = least <= best[who, -1]
            who, least = who[alive], least[alive]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                self._scan(node, who, queries, own, ids, best, rows)
                continue
            centre, radius, inner, outer = node
            self._scan(centre, who, queries, own, ids, best, rows)
            d = np.sqrt(((queries[who] - self.points[centre]) ** 2).sum(1))
            # rounding of d and radius must not leave out an equal distance
            slack = 1e-9 * (1 + radius)
            to_inner = np.maximum(least, (d - radius) * factor - slack)
            to_outer = np.maximum(least, (radius - d) * factor - slack)
            near = d <= radius
            # the nearer side is searched first: the last pushed comes first
            for near_side in (True, False):
                side = near if near_side else ~near
                if side.any():
                    pair = [(outer, who[side], to_outer[side]), (inner, who[side], to_inner[side])]
                    stack.extend(pair if near_side else pair[::-1])
        return rows, best

    def _scan(self, leaf, who, queries, own, ids, best, rows) -> None:
        step = max(1, (1 << 22) // (len(leaf) * queries.shape[1]))
        for i in range(0, len(who), step):
            w = who[i : i + step]
            d = np.zeros((len(w), len(leaf)))
            points = self.points[leaf]
            for j in range(queries.shape[1]):  # parts are added in order, as a plain loop would
                d += (queries[w, j, None] - points[None, :, j]) ** 2
            d = np.sqrt(d)
            d[ids[leaf][None, :] == own[w, None]] = np.inf
            both_d = np.concatenate([best[w], d], 1)
            both_r = np.concatenate([rows[w], np.broadcast_to(leaf, d.shape)], 1)
            both_r[np.isinf(both_d)] = -1
            tie = np.where(both_r >= 0, ids[both_r], np.iinfo(np.int64).max)
            order = np.lexsort((tie, both_d), axis=1)[:, : best.shape[1]]
            best[w] = np.take_along_axis(both_d, order, 1)
            rows[w] = np.take_along_axis(both_r, order, 1)


class _Shard:
    """A shard's vectors, by length, and their trees once the first query has come."""

    def __init__(self, leaf: int):
        self.leaf, self.held, self.trees = leaf, {}, None

    def add(self, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        for i, v in zip(ids.tolist(), vectors, strict=True):
            self.held.setdefault(len(v), []).append((i, v))

    def search(self, ids: np.ndarray, vectors: list[np.ndarray], k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, vector ids, distances); vectors of another length have no distance."""
        if self.trees is None:
            self.trees = {}
            for width, rows in self.held.items():
                rows.sort(key=lambda r: r[0])
                self.trees[width] = np.array([i for i, _ in rows], np.int64), Tree(np.array([v for _, v in rows], np.float64), self.leaf)
            self.held = {}
        size = np.array([len(v) for v in vectors])
        for width in np.unique(size).tolist():
            if width in self.trees:
                own, tree = self.trees[width]
                at = np.flatnonzero(size == width)
                rows, d = tree.search(np.array([vectors[i] for i in at], np.float64), ids[at], own, k, factor)
                found = rows >= 0
                yield np.repeat(ids[at], found.sum(1)), own[rows[found]], d[found]


def _searcher(k: int, factor: float, leaf: int):
    """Over rows sorted by shard, vectors before queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, _Shard(leaf)
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asked = batch.column("shard").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            ids, vectors = batch.column("id").to_numpy(), [np.asarray(v) for v in np.split(batch.column("vector").flatten().to_numpy(), np.cumsum(pc.list_value_length(batch.column("vector")).to_numpy())[:-1])]
            edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asked[1:] != asked[:-1])]).tolist() + [len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                if shards[a] != number:
                    number, shard = shards[a], _Shard(leaf)
                if not asked[a]:
                    shard.add(ids[a:b], vectors[a:b])
                    continue
                for q, v, d in shard.search(ids[a:b], vectors[a:b], k, factor):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(d)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors, nearest first, ties to the smaller vec_id.

    vectors(vec_id, embedding), queries(query_id, embedding). A query does not
    find its own id. Vectors that are null, empty, zero or hold null or
    non-finite parts take no part, on either side, nor do rows without id;
    vectors of another length are never found. Of repeated rows of an id one is
    found; which one is settled by the smallest embedding. A query with fewer
    candidates has fewer rows. Other columns are not read; empty tables give an
    empty result.
    """
    def clean(df: DataFrame, name: str) -> DataFrame:
        plain = df.select(F.col(name).cast("long").alias("id"), F.col("embedding").alias("vector"))
        return plain.filter(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))

    points, asked = cut(clean(vectors, "vec_id")), cut(clean(queries, "query_id"))
    shards = max(1, -(-points.count() // shard_rows))
    left = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "id", "vector")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "id", "vector")
    dealt = left.union(right).repartition("shard").sortWithinPartitions("shard", "is_query", "id")
    found = dealt.mapInArrow(_searcher(k, factor, leaf), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
