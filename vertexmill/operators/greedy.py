"""Greedy grouping under a conflict rule: edges join groups in their order unless the groups share an image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexmill.operators.components import connected_components
from vertexmill.plans.checkpoints import discard, written

#: Edges, or edges and images, that one task settles at once; it sizes the work, not what can be settled.
TASK_ROWS = 1_000_000
#: Edges of small components that a task settles together, about.
BUCKET_EDGES = 50_000
#: Up to so many images of a task are bits of a number.
FEW_IMAGES = 62
#: Of a group of more images, edges are not compared with those of other groups before their turn.
LISTED_IMAGES = 64
#: Types of place, or of its fields, that a task can sort as they are; edges of other places are ranked.
SORTED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)


def _ranked(edges: DataFrame) -> DataFrame:
    """edges(u, v, place) with rank, the number of an edge in the order of place, from the counts of range partitions."""
    parts = written(edges.repartitionByRange("place").sortWithinPartitions("place").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).select("u", "v", "part", "row"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("u", "v", (F.col("before") + F.col("row")).alias("rank"))


def greedy_groups(edges: DataFrame, images: DataFrame | Column, task_rows: int = TASK_ROWS, component: DataFrame | None = None) -> DataFrame:
    """(node, root) of edges(u, v, place), taken by place; images(node, image), or the image as an expression of node.

    An edge joins its ends' groups unless an image belongs to both; a refused
    edge leaves both as they are, for good, as groups only grow. root is a
    group's smallest node. Nodes without edges have no row. Of edges of equal
    place either may come first. component(node, component) may be given if
    it is known.

    Groups only interact inside a connected component. A component without an
    image in two nodes is a group; those of task_rows edges and images or fewer
    are settled edge by edge, many in a task. What is left goes by prefixes: see
    _by_prefixes(). Only images that stand in two nodes of a component go to a
    task.
    """
    edges = edges.filter("u <> v").select("u", "v", "place")
    if component is None:
        edges = written(edges)
        component = written(connected_components(edges))
    placed = component.select("component", "node", images.alias("image")) if isinstance(images, Column) else component.join(images, "node").select("component", "node", "image")
    placed = placed.filter("image is not null")
    shared = written(placed.groupBy("component", "image").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("component", "image"))
    busy = written(shared.select("component").distinct())
    calm = component.join(busy, "component", "left_anti").select("node", F.col("component").alias("root"))
    if busy.isEmpty():
        return calm
    return calm.union(_round(edges, placed, shared, component.join(busy, "component", "left_semi"), max(2, task_rows)))


def _round(edges: DataFrame, placed: DataFrame, shared: DataFrame, component: DataFrame, most: int) -> DataFrame:
    """(node, root) of the components, in which images repeat: shared(component, image)."""
    component = written(component)
    inside = written(edges.join(component.select(F.col("node").alias("u"), "component"), "u").select("component", "u", "v", "place"))
    held = written(placed.join(shared, ["component", "image"], "left_semi").distinct())
    sizes = inside.groupBy("component").agg(F.count("*").alias("edges")).join(held.groupBy("component").agg(F.count("*").alias("images")), "component")
    sizes = written(sizes.select("component", (F.col("edges") + F.col("images") > most).alias("is_large")))
    large = sizes.filter("is_large").select("component")
    if large.isEmpty():
        return _small(inside, held)
    out = _by_prefixes(*[t.join(large, "component", "left_semi").drop("component") for t in (inside, held, component)], most)
    if sizes.filter("not is_large").isEmpty():
        return out
    return out.union(_small(*[t.join(sizes.filter("not is_large"), "component", "left_semi") for t in (inside, held)]))


def _small(edges: DataFrame, held: DataFrame) -> DataFrame:
    """(node, root) of edges(component, u, v, place) with held(component, node, image): components share no group, so they are dealt into buckets, and a bucket's are settled together."""
    place = edges.schema["place"].dataType
    fields = place.fields if isinstance(place, T.StructType) else [T.StructField("place", place)]
    if all(isinstance(f.dataType, SORTED) for f in fields):
        order = [(F.col("place") if f.name == "place" and not isinstance(place, T.StructType) else F.col("place")[f.name]).alias(f"place_{k}") for k, f in enumerate(fields)]
    else:
        home = edges.select(F.col("u").alias("of"), "component").distinct()
        edges, order = _ranked(edges).withColumn("of", F.col("u")).join(home, "of"), [F.col("rank").alias("place_0")]
    keys = [f"place_{k}" for k in range(len(order))]
    edges = written(edges.select("component", "u", "v", *order))
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-edges.count() // BUCKET_EDGES)))).alias("of")

    def run(edges: pa.Table, images: pa.Table) -> pa.Table:
        nodes, root, *_ = _settled(edges, keys, images.column("node"), images.column("image"))
        return pa.table({"node": nodes, "root": root})

    return edges.select(bucket, "u", "v", *keys).groupBy("of").cogroup(held.select(bucket, "node", "image").groupBy("of")).applyInArrow(run, "node long, root long")


def _settled(edges: pa.Table, keys: list[str], of: pa.ChunkedArray, image: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """The ends of edges and the smallest of each one's group, edges taken by keys; the groups that others joined, and their images of those given as rows (of, image)."""
    order = pc.sort_indices(edges.select(keys), [(k, "ascending") for k in keys], null_placement="at_start")
    u, v = (edges.column(c).take(order).to_numpy() for c in "uv")
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    at, code = np.searchsorted(nodes, of.to_numpy()), pc.dictionary_encode(image.combine_chunks())
    if isinstance(code, pa.ChunkedArray):
        code = code.combine_chunks()
    names, number = code.dictionary, code.indices.to_numpy()
    few = len(names) <= FEW_IMAGES
    # a group's images are bits of a number, or a set
    if few:
        bits = np.zeros(len(nodes), np.int64)
        np.bitwise_or.at(bits, at, np.int64(1) << number.astype(np.int64))
        held = bits.tolist()
    else:
        held = [frozenset()] * len(nodes)
        by = np.argsort(at, kind="stable")
        start = np.flatnonzero(np.diff(at[by], prepend=-1))
        for n, own in zip(at[by][start].tolist(), np.split(number[by], start[1:]), strict=True):
            held[n] = frozenset(own.tolist())
    parent = list(range(len(nodes)))
    joined = set()

    def find(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in zip(*ends.reshape(2, -1).tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b and not held[a] & held[b]:
            if b < a:
                a, b = b, a
            parent[b] = a
            held[a], held[b] = held[a] | held[b], None
            joined.add(a)
    root = np.array([find(n) for n in range(len(nodes))], dtype=np.int64)
    grown = np.array(sorted(n for n in joined if parent[n] == n), dtype=np.int64)
    own = [held[n] for n in grown.tolist()]
    if few:
        there = (np.array(own, dtype=np.int64)[:, None] >> np.arange(len(names)) & 1).astype(bool)
        sizes, each = there.sum(1), np.nonzero(there)[1]
    else:
        sizes, each = np.array([len(x) for x in own], dtype=np.int64), np.array([i for x in own for i in x], dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), names.take(pa.array(each, pa.int64())))
    return nodes, nodes[root], nodes[grown], lists


def _by_prefixes(edges: DataFrame, held: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(node, root) of nodes(node) with edges(u, v, place) and held(node, image), of components that no task should hold.

    Edges are taken range by range of their rank. All earlier ones being
    settled, those of a range are moved to the groups of their ends, and go if
    these are one group or share an image already, so that a range of ever more
    edges leaves as few open ones as a task settles. If it leaves more, and
    their components are no larger than that, tasks settle components side by
    side; else the range is cut. Of a range only groups that joined others
    change.
    """
    ranked = written(_ranked(edges))
    lists = written(held.groupBy(F.col("node").alias("root")).agg(F.collect_list("image").alias("images")))
    known = written(nodes.select("node", F.col("node").alias("root")).join(lists, "root", "left").select("node", "root", F.when(F.size("images") <= LISTED_IMAGES, F.col("images")).alias("images")))
    n, at, width = ranked.count(), 0, most
    schema = f"root long, low long, images {lists.schema['images'].dataType.simpleString()}"
    while at < n:
        open_ = written(_open(ranked.filter((F.col("rank") >= at) & (F.col("rank") < at + width)), known))
        left = open_.count()
        if left:
            bucket = F.lit(0)
            if left > most:
                component = written(connected_components(open_))
                open_, bare = written(open_.join(component.select(F.col("node").alias("u"), "component"), "u")), open_
                discard(bare)
                discard(component)
                if open_.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > most:
                    discard(open_)
                    width = max(1, width * most // (2 * left))
                    continue
                bucket = F.pmod(F.xxhash64("component"), F.lit(-(-left // BUCKET_EDGES)))
            joined = written(_joined(open_, lists, bucket, schema))
            known, lists = _moved(known, lists, joined)
            discard(joined)
        discard(open_)
        at += width
        width = max(1, int(width * min(4.0, max(0.25, 0.75 * most / max(left, 1)))))
    discard(ranked)
    return known.select("node", "root")


def _open(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges(u, v, rank) between the groups known(node, root, images) of their ends, the first of each two groups, without those within a group or of groups that share a listed image."""
    side = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("images").alias(f"images_{c}")).hint("merge")
    placed = edges.join(side("u"), "u").join(side("v"), "v").filter("root_u <> root_v and not coalesce(arrays_overlap(images_u, images_v), false)")
    return placed.groupBy(F.least("root_u", "root_v").alias("u"), F.greatest("root_u", "root_v").alias("v")).agg(F.min("rank").alias("rank"))


def _joined(edges: DataFrame, lists: DataFrame, bucket: Column, schema: str) -> DataFrame:
    """(root, low, images): groups of edges(u, v, rank, ...) that go into low, themselves included, and low's images, in its own row; lists(root, images) are those of the groups before."""
    dealt = edges.select(bucket.alias("of"), "u", "v", "rank")
    ends = dealt.select("of", F.explode(F.array("u", "v")).alias("root")).distinct()

    def run(edges: pa.Table, images: pa.Table) -> pa.Table:
        flat = pc.list_flatten(images.column("images").combine_chunks())
        of = np.repeat(images.column("root").to_numpy(), pc.list_value_length(images.column("images")).to_numpy())
        nodes, root, grown, made = _settled(edges, ["rank"], pa.chunked_array([of], pa.int64()), pa.chunked_array([flat]))
        new = np.isin(root, grown)
        nodes, root = nodes[new], root[new]
        own = pa.array(np.searchsorted(grown, nodes), mask=nodes != root)
        return pa.table({"root": nodes, "low": root, "images": made.take(own)})

    return dealt.groupBy("of").cogroup(lists.join(ends, "root").select(F.col("of").alias("of"), "root", "images").groupBy("of")).applyInArrow(run, schema)


def _moved(known: DataFrame, lists: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """known(node, root, images) and lists(root, images) after joined(root, low, images), written down; the old files go."""
    whole = joined.filter("root = low").select("root", "images")
    made = joined.select("root", "low").join(whole.select(F.col("root").alias("low"), F.col("images").alias("all")), "low").select("root", "low", F.when(F.size("all") <= LISTED_IMAGES, F.col("all")).alias("all"))
    new = known.join(made.hint("merge"), "root", "left").select("node", F.coalesce("low", "root").alias("root"), F.when(F.col("low").isNull(), F.col("images")).otherwise(F.col("all")).alias("images"))
    out = written(new), written(lists.join(joined.select("root").hint("merge"), "root", "left_anti").select("root", "images").union(whole))
    for old in (known, lists):
        discard(old)
    return out
