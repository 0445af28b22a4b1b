"""Mixing sources to target weights by weighted fair queueing.

Every document joins its source's queue once per epoch, in an order shuffled by
the MD5 of its id and epoch. Its virtual finish time is the source's tokens up
to and with it, divided by the source's target. The queues are served in order
of finish time until the budget is spent; the document at the cut is taken in
part.

Prefix sums are made in two levels, so that no source, however large, meets in
one task: sums by (source, epoch, MD5 prefix) first, then a running sum inside
each of those small cells; the cut is found from a histogram of finish times
and only the histogram cell that holds it is ordered in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, free_name, words

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Rows that a cell of the prefix sums holds, about.
CELL_ROWS = 20_000
FINISH_CELLS = 4096
#: The table of sources is broadcast up to so many rows.
MOST_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    # only the first and the last part can be empty
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn and share
    the sum of all sizes; a target stops at `epochs` times its source's size and
    the excess is shared again among the others. An empty table gives none. The
    table has one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(totals.select("source", "source_size", rank.alias("source_rank"), weight.alias("weight")))
    cap = F.col("source_size") * F.lit(float(epochs))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    while True:  # each turn caps at least one more source; one aggregate a turn
        held, free = ranked.agg(
            F.coalesce(F.sum(F.when(cap <= F.col("weight") * level, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(cap > F.col("weight") * level, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not free:
            break
        new = (total - held) / free
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def schedule(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The queue: a row per document and epoch, (doc_id, source, size, source_size, source_rank, target, epoch, finish, taken).

    Nulls: a null text has size 0, a null source is a source of its own (last),
    a null id is shuffled as the empty string. Documents of size 0 are queued
    and take nothing. Repeated rows are documents of their own; rows alike in
    every column are interchangeable. Other columns of docs are not read. An
    empty table gives an empty queue.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return _queue(sized, weights, epochs, cell_rows)


def _queue(sized: DataFrame, weights, epochs: int, cell_rows: int) -> DataFrame:
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    rows = sized.count()
    digits = max(1, math.ceil(math.log(max(1, rows / cell_rows), 16)))
    if shares.count() <= MOST_BROADCAST_SOURCES:
        shares = F.broadcast(shares)
    same = F.col("q.source").eqNullSafe(F.col("s.source"))
    queue = (
        sized.alias("q").join(shares.alias("s"), same).select("q.*", "source_size", "source_rank", "target")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .withColumn("draw", F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("epoch").cast("string")).cast("binary")))
        .withColumn("cell", F.substring("draw", 1, digits))
    )
    cells = queue.groupBy("source_rank", "epoch", "cell").agg(F.sum("size").alias("cell_size"))
    before = F.coalesce(F.sum("cell_size").over(Window.partitionBy("source_rank").orderBy("epoch", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("source_rank", "epoch", "cell", before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source_rank", "epoch", "cell").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    queue = queue.withColumn("inside", inside).join(cells, ["source_rank", "epoch", "cell"])
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("inside")) / F.col("target")).otherwise(0.0)
    return _serve(queue.withColumn("finish", finish))


def _serve(queue: DataFrame) -> DataFrame:
    """Order by finish time and cut at the budget."""
    queue = cut(queue.withColumn("slot", F.least(F.floor(F.col("finish") * (FINISH_CELLS / 2)), F.lit(4 * FINISH_CELLS)).cast("int")))
    slots = queue.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    total = queue.select("source_rank", "source_size").distinct().agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    # at most 4 * FINISH_CELLS + 1 slots
    served = slots.crossJoin(total).withColumn("served", F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slot_size"))
    queue = queue.join(F.broadcast(served.select("slot", "served", "slot_size", "budget")), "slot")
    whole = queue.filter(F.col("served") + F.col("slot_size") <= F.col("budget")).withColumn("taken", F.col("size"))
    at_cut = queue.filter((F.col("served") + F.col("slot_size") > F.col("budget")) & (F.col("served") < F.col("budget")))
    running = F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "source_rank", "draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    at_cut = at_cut.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("served") - running + F.col("size"))))
    late = queue.filter((F.col("served") + F.col("slot_size") > F.col("budget")) & (F.col("served") >= F.col("budget"))).withColumn("taken", F.lit(0).cast("long"))
    return whole.unionByName(at_cut).unionByName(late)


def mix_report(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (all epochs together)."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    queue = _queue(sized, weights, epochs, CELL_ROWS)
    return queue.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").cast("long").alias("source_size"),
        F.first("target").alias("target"), F.sum("taken").cast("long").alias("taken"),
    ).drop("row")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: docs' columns, a row per epoch in which a document is served, in finish order; the text at the cut is shortened to the words taken.

    Texts stay out of the queue; ids and sizes wait in it. Repeated rows are
    matched by their number among the rows of one id, source and text, and
    served each. Null texts and documents of size 0 are not served; null ids
    and sources as in schedule(). Other columns may have any names; an empty
    table stays empty.
    """
    hash_, nth, size, taken, finish = (free_name(docs, f"mix_{n}") for n in ("hash", "nth", "size", "taken", "finish"))
    alike = Window.partitionBy("doc_id", "source", hash_).orderBy(F.lit(0))
    placed = docs.withColumn(hash_, F.xxhash64("text")).withColumn(nth, F.row_number().over(alike))
    key = [F.col("doc_id"), F.col("source"), F.col(hash_).alias("mix_hash"), F.col(nth).alias("mix_nth")]
    queue = _queue(cut(placed.select(*key, word_count(F.col("text")).alias("size"))), weights, epochs, CELL_ROWS).filter("taken > 0")
    served = queue.select(F.col("doc_id").alias(f"{hash_}_id"), F.col("source").alias(f"{hash_}_source"), F.col("mix_hash").alias(f"{hash_}_hash"), F.col("mix_nth").alias(f"{hash_}_nth"), F.col("size").alias(size), F.col("taken").alias(taken), F.col("finish").alias(finish))
    same = F.col("doc_id").eqNullSafe(F.col(f"{hash_}_id")) & F.col("source").eqNullSafe(F.col(f"{hash_}_source")) & (F.col(hash_) == F.col(f"{hash_}_hash")) & (F.col(nth) == F.col(f"{hash_}_nth"))
    short = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(taken).cast("int")), " ")
    out = placed.join(served, same).withColumn("text", F.when(F.col(taken) < F.col(size), short).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.orderBy(finish, "doc_id", hash_, nth).select(*[F.col(f"`{c}`") for c in docs.columns])
