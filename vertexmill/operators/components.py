"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexmill.plans.checkpoints import discard, written

#: So few links, 16 bytes each, are settled in one task.
TASK_EDGES = 200_000
#: So many links are contracted at once within a task.
CHUNK_LINKS = 1_000_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m), written down: the smallest of u and its neighbours v. Partial sums make a hub a row a task."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Larger neighbours of u go to the smallest of all its neighbours; and the minima, for disposal."""
    pairs = _both_ways(edges)
    low = _smallest(pairs)
    return pairs.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Smaller neighbours of u, and u, go to the smallest of them; and the minima. edges: u > v."""
    low = _smallest(edges)
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct(), low


def _settled(links: DataFrame) -> bool:
    """Whether every node points to one other, which points to none."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("out")).union(links.select("v", F.lit(0)))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least")).filter("out > 1 or (out = 1 and least = 0)").isEmpty()


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node of each one's component: each takes the smallest label over its links and then its label's label, until none changes."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (label[u], label[v], u, v):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_a_task(links: pd.DataFrame) -> pd.DataFrame:
    """(node, component) of few links."""
    nodes, component = _labels(links["u"].to_numpy(), links["v"].to_numpy())
    return pd.DataFrame({"node": nodes, "component": component})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the components of each CHUNK_LINKS of a task's links alone."""
    def labelled(chunk: list) -> Iterator[pa.RecordBatch]:
        nodes, label = _labels(*[np.concatenate([b.column(c).to_numpy() for b in chunk]) for c in "uv"])
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_pydict({"node": nodes[k : k + 100_000], "label": label[k : k + 100_000]})

    chunk, n = [], 0
    for batch in batches:
        chunk.append(batch)
        n += batch.num_rows
        if n >= CHUNK_LINKS:
            yield from labelled(chunk)
            chunk, n = [], 0
    if n:
        yield from labelled(chunk)


def connected_components(edges: DataFrame, max_rounds: int = 100, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for the nodes of edges(u, v); component is its smallest node.

    Rows with a null end and loops are ignored, repeated edges count once; a
    node that stands in loops only has no row. An empty table gives an empty
    result. Neighbouring links, by a range of their ends, are first contracted
    within tasks; what is left are links between the labels of nodes that stand
    in several tasks, which take rounds. Every step of these is a minimum by key
    and an equi-join with the minima. These are written down first, so that both sides of the join are plain
    shuffles, which adaptive execution splits where a node has very many
    neighbours; minima and the check for the end are sums with partial sums.
    Neighbours are never listed. Each round is written down, and the files of
    the round before are deleted. Once there are no more than task_edges links,
    one task settles them.
    """
    links = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    near = written(links.repartitionByRange("u", "v").mapInArrow(_near, "node long, label long"))
    if near.count() <= task_edges:
        return near.select(F.col("node").alias("u"), F.col("label").alias("v")).groupBy(F.lit("all")).applyInPandas(_in_a_task, "node long, component long")
    low = written(near.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("high")))
    # a node of several labels links them
    torn = low.filter("label < high").select("node", F.col("label").alias("v"))
    between = written(near.join(torn, "node").filter("label > v").select(F.col("label").alias("u"), "v").distinct())
    discard(near)
    joined = written(_in_rounds(between, max_rounds, task_edges))
    found = low.join(joined.select(F.col("node").alias("label"), "component"), "label", "left")
    return found.select("node", F.coalesce("component", "label").alias("component"))


def _in_rounds(links: DataFrame, max_rounds: int, task_edges: int) -> DataFrame:
    """connected_components of distinct links(u, v), u > v, that are written down."""
    for n in range(max_rounds):
        if links.count() <= task_edges:
            return links.groupBy(F.lit("all")).applyInPandas(_in_a_task, "node long, component long")
        if n:
            made, low_large = _large_star(links)
            large = written(made)
        else:
            large, low_large = links, None
        made, low_small = _small_star(large)
        new = written(made)
        for old in (links, large, low_large, low_small):
            discard(old)
        links = new
        if _settled(links):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
