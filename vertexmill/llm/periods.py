"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, of at least
max(12, 2 q) words, that no neighbouring word extends at period q.

For each power of two L the blocks of L words of a text get names, equal for
equal blocks of the text; the name of a block of 2 L words is that of the pair
of its halves, so that all names of a text take O(n log n) numbers. Blocks that
occur once in their text get none, and only pairs of named blocks are named at
the next length, so that lengths without a repeat cost nothing.

Periods q of L <= q <= 2 L are proposed at length L. Occurrences of a block at
distances of L / 2 or less stand in an arithmetic progression, whose step is
the block's own period. From the last member of a progression every later
occurrence of the block at a distance of L to 2 L is a proposal, and to the
first member every earlier one. This finds every run: its first block occurs
again q words on, in another progression (else q were not the smallest
period); if neither a block of the run's front is its progression's last nor
the block q words on its progression's first, both progressions meet, which
makes them one. A block takes part in a bounded number of proposals, as at
most four progressions lie within 2 L.

Proposals of one period that overlap are one. Each is extended to both sides
by the names, longest blocks first, and stretches that come up at several
periods keep the smallest, which is then the stretch's smallest period.

Words are compared as bytes (a dictionary of the batch's words), not by hash.
The batch's texts are worked on together, SLICE_BYTES at a time, a longer text
alone: memory is 4 bytes for each word and power of two, no cap on a text.

Null texts have no words. Rows of one id, and rows without, are judged each for
itself. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import let, words

#: A run has so many words at least.
LEAST_WORDS = 12


def _levels(names: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """names, int64 and different between texts, and the end of each place's text: for each power of two the number of each place's block, -1 where it is not repeated or reaches over the end."""
    n = len(names)
    at, key, out, size = np.arange(n), names, [], 1
    while len(at):
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(len(ranked), bool)
        new[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        lone = new & np.append(new[1:], True)
        number = np.cumsum(new) - 1
        level = np.full(n, -1, np.int32)
        level[at[order]] = np.where(lone, -1, number)
        if lone.all():
            break
        out.append(level)
        at = np.flatnonzero(level >= 0)
        at = at[at + 2 * size <= stop[at]]
        at = at[level[at + size] >= 0]
        key = level[at].astype(np.int64) * (int(level.max()) + 1) + level[at + size]
        size *= 2
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, index): all indices of the ranges [low, high), with their range's number."""
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _proposals(level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of blocks of this size that occur again a period on."""
    at = np.flatnonzero(level >= 0)
    order = np.argsort(level[at], kind="stable")
    at = at[order]
    # names apart by more than any distance that is asked for
    key = level[at].astype(np.int64) * (len(level) + 2 * size + 1) + at
    breaks = np.diff(key) > size // 2
    first, last = np.append(True, breaks), np.append(breaks, True)
    ends, starts = np.flatnonzero(last), np.flatnonzero(first)
    a, later = _spread(np.searchsorted(key, key[ends] + size), np.searchsorted(key, key[ends] + 2 * size, "right"))
    b, before = _spread(np.searchsorted(key, key[starts] - 2 * size), np.searchsorted(key, key[starts] - size, "right"))
    place = np.concatenate([at[ends[a]], at[before]])
    return place, np.concatenate([at[later], at[starts[b]]]) - place


def find(names: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of consecutive texts of words, ordered by start, then period. names: a number a word, below 2**31; bounds: of the texts."""
    none = np.zeros(0, np.int64)
    if not len(names):
        return none, none, none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    levels = _levels(text * (int(names.max()) + 1) + names, bounds[text + 1])
    found = [_proposals(level, 1 << k) for k, level in enumerate(levels)]
    if not found:
        return none, none, none
    left, period = (np.concatenate(x) for x in zip(*found, strict=True))
    right = left + np.repeat([1 << k for k in range(len(found))], [len(x) for x, _ in found])
    order = np.lexsort((left, period))
    left, right, period = left[order], right[order], period[order]
    # overlapping proposals of a period: the one that reaches furthest so far, periods apart
    apart = period * (2 * len(names) + 2)
    reach = np.maximum.accumulate(apart + right)
    new = np.append(True, apart[1:] + left[1:] > reach[:-1]) if len(left) else np.zeros(0, bool)
    group = np.flatnonzero(new)
    right = np.maximum.reduceat(right, group) if len(group) else right
    left, period = left[group], period[group]
    for k in range(len(levels) - 1, -1, -1):
        level, size = levels[k], 1 << k
        far = right + period
        ok = far + size <= len(names)
        a, b = level[np.where(ok, right, 0)], level[np.where(ok, far, 0)]
        right = right + size * (ok & (a == b) & (a >= 0))
        ok = left >= size
        a, b = level[np.where(ok, left - size, 0)], level[np.where(ok, left - size + period, 0)]
        left = left - size * (ok & (a == b) & (a >= 0))
    length = right + period - left
    long = length >= np.maximum(least, 2 * period)
    left, length, period = left[long], length[long], period[long]
    order = np.lexsort((period, length, left))
    left, length, period = left[order], length[order], period[order]
    one = np.append(True, (left[1:] != left[:-1]) | (length[1:] != length[:-1])) if len(left) else np.zeros(0, bool)
    left, length, period = left[one], length[one], period[one]
    order = np.lexsort((period, left))
    return left[order], length[order], period[order]


class _Slice:
    """A slice of texts: their words' names and bytes, and their runs."""

    def __init__(self, w: tx.Words):
        self.bounds, self.size = w.first.astype(np.int64), (w.stop - w.start).astype(np.int64)
        self.flat = np.ascontiguousarray(w.data[w._inside])
        offsets = np.concatenate([[0], np.cumsum(self.size)])
        column = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(self.flat)])
        names = column.dictionary_encode().indices.to_numpy().astype(np.int64) if len(w) else np.zeros(0, np.int64)
        self.start, self.length, self.period = find(names, self.bounds)
        self.cuts = np.searchsorted(self.start, self.bounds)

    def kept(self) -> np.ndarray:
        """Which words stay: all but those that a run holds after its first period."""
        change = np.zeros(len(self.size) + 1, np.int64)
        np.add.at(change, self.start + self.period, 1)
        np.add.at(change, self.start + self.length, -1)
        return np.cumsum(change[:-1]) == 0

    def collapsed(self) -> Iterator[tuple[int, memoryview]]:
        """Of each text the number of words that stay, and these joined by one space."""
        kept = self.kept()
        size = self.size[kept]
        out = np.full(int(size.sum()) + len(size), 32, np.uint8)
        data = self.flat[np.repeat(kept, self.size)]
        out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
        number = np.concatenate([[0], np.cumsum(kept)])[self.bounds]
        place = np.concatenate([[0], np.cumsum(size + 1)])[number].tolist()
        view, number = memoryview(out), number.tolist()
        for t in range(len(self.bounds) - 1):
            yield number[t + 1] - number[t], view[place[t] : max(place[t], place[t + 1] - 1)]


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period), a row a run of docs(doc_id, text); start is a word's number from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, _, w in tx.slices(batch.column("text")):
                s = _Slice(w)
                text = np.searchsorted(s.bounds, s.start, "right") - 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + text)), *map(pa.array, (s.start - s.bounds[text], s.length, s.period))], names=["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each text the words that stay when every run keeps its first period only, joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, w in tx.slices(batch.column("text")):
                texts = pa.array([bytes(x) for _, x in _Slice(w).collapsed()], pa.large_binary()).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), texts.cast(pa.string()) if texts.nbytes < 1 << 31 else texts], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_runs, start, length, period and exponent_milli of its longest run (ties: smallest start, then period; null without a run), runs_sha256, collapsed_sha256, n_words, n_kept."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, w in tx.slices(batch.column("text")):
                s, rows = _Slice(w), []
                bounds, cuts = s.bounds.tolist(), s.cuts.tolist()
                for t, (n_kept, text) in enumerate(s.collapsed()):
                    a, b, first = cuts[t], cuts[t + 1], bounds[t]
                    mine = list(zip((s.start[a:b] - first).tolist(), s.length[a:b].tolist(), s.period[a:b].tolist(), strict=True))
                    best = max(mine, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
                    exponent = 1000 * best[1] // best[2] if mine else None
                    listed = hashlib.sha256("".join([f"{i},{n},{p}\n" for i, n, p in mine]).encode()).hexdigest()
                    rows.append((len(mine), *best, exponent, listed, hashlib.sha256(text).hexdigest(), bounds[t + 1] - first, n_kept))
                kinds = [pa.string() if "sha256" in c else pa.int64() for c in names[1:]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def plant(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with every tenth text made periodic from some word on, by the CRC-32 of its doc_id; rows without id stay."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def periodic(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")

    planted = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))
