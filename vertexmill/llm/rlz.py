"""Substring dedup by relative Lempel-Ziv parsing.

A document is parsed relative to all documents of smaller id. The reference is
cut into blocks of words, each running on by a window less one word, so that
every window lies in one block. All blocks are indexed by the hashes of their
50-word seeds; the index keeps each seed's first place. The parse is greedy: at a
document's first seed that hits the index, the factor is the longest match of
the document's words with the words of the block from that place on. The next
factor is looked for among the seeds that straddle the end of the factor, or
stand behind it, so a repeated window that would be split between two factors is
found at their boundary. A factor counts if it is a window long; the words under
factors are the words under repeated windows.

Only seeds that can hit go through the index. Every seed has an anchor, the
smallest hash of the 10-word runs inside it; equal seeds have equal anchors, so
a seed is looked up only when its anchor occurs in two different texts. About
one word in twenty is an anchor. Exact copies are settled first, by the SHA-256 of
their words, outside the parse. Words are compared by hash: a seed by 96 bits of
its own, and every word of a factor by 32 bits; blocks are fetched once for each
document that hits them, as these. A text is named by doc_id and row: 0 if the
id has one text, else the text's hash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import cut, free_name, written

WINDOW = 50
ANCHOR = 10
#: Windows that begin in a block of the reference.
BLOCK = 128
#: A filter of the texts that are wanted has 16 bits for each of them, and at most so many in all (32 MB).
MOST_BITS = 1 << 28
CHUNK_BITS = 1 << 19


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of every window of a text."""
    return tx.sliding_min(tx.windows(hashes, anchor), window - anchor + 1)


def _join(w: tx.Words, text: int, keep: np.ndarray | None = None) -> bytes:
    """A text's words, or those kept, with one space between."""
    a, b = w.first[text], w.first[text + 1]
    start, stop = w.start[a:b], w.stop[a:b]
    if keep is not None:
        start, stop = start[keep], stop[keep]
    if not len(start):
        return b""
    gap = np.flatnonzero(start[1:] != stop[:-1] + 1)  # runs that already stand one byte apart
    first, last = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(start) - 1]])
    return b" ".join(w.data[i:j].tobytes().translate(_BLANK) for i, j in zip(start[first].tolist(), stop[last].tolist(), strict=True))


#: Other white space becomes a space.
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _summary(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, digests, anchors = [], [], []
            for row, end, w in tx.slices(batch.column("text")):
                h = w.hashes()
                for i in range(end - row):
                    own = h[w.first[i] : w.first[i + 1]]
                    n_words.append(len(own))
                    digests.append(hashlib.sha256(_join(w, i)).hexdigest())
                    anchors.append(np.unique(_anchors(own, window, anchor)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32)
            values = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "row_hash", "n_words", "digest", "anchors"],
            )

    return run


def _seeds(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("shared")
            for row, end, w in tx.slices(batch.column("text")):
                h = [w.hashes(0), w.hashes(1)]
                for i in range(end - row):
                    a, b = w.first[i], w.first[i + 1]
                    own = _anchors(h[0][a:b], window, anchor)
                    at = np.flatnonzero(np.isin(own, shared[row + i].values.to_numpy().view(np.uint64)))
                    if not len(at):
                        continue
                    n = len(at)
                    one = tx.windows(h[0][a:b], window, 0)[at].view(np.int64)
                    two = (tx.windows(h[1][a:b], window, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    ids = [pa.array(np.full(n, batch.column(c)[row + i].as_py(), np.int64)) for c in ("doc_id", "row")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(at.astype(np.int32)), pa.array(one), pa.array(two)], names=["doc_id", "row", "at", "one", "two"])

    return run


def parse(words: np.ndarray, hits: np.ndarray, refs: list[tuple[int, int]], places: np.ndarray, blocks: dict[tuple[int, int, int], np.ndarray], window: int, block: int = BLOCK) -> list[tuple[int, int, int, int]]:
    """The greedy factors (start, length, reference, place) of a text.

    words: hashes of the text's words. hits: places of seeds that hit the index,
    ascending; refs and places: (id, row) and place of each one's first
    occurrence. blocks: by id, row and number, the words of reference blocks.
    """
    out, i = [], 0
    starts = hits.tolist()
    while i < len(starts):
        at, place = starts[i], int(places[i])
        there = blocks[(*refs[i], place // block)][place % block :]
        here = words[at : at + len(there)]
        differ = np.flatnonzero(here != there[: len(here)])
        length = int(differ[0]) if len(differ) else len(here)
        if length < window:  # equal hashes of different words
            i += 1
            continue
        out.append((at, length, refs[i][0], place))
        # seeds that lie inside the factor are done with; those that straddle its end are not
        i = bisect.bisect_right(starts, at + length - window)
    return out


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _blocks(window: int):
    """The blocks of reference texts whose numbers are wanted; rows alike that come one after the other give them once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            wanted, names = batch.column("wanted"), list(zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), strict=True))
            rows, numbers, content = [], [], []
            for row, end, w in tx.slices(batch.column("text")):
                h = _short(w.hashes())
                for i in range(end - row):
                    if names[row + i] == before:
                        continue
                    before = names[row + i]
                    own = h[w.first[i] : w.first[i + 1]]
                    for n in wanted[row + i].as_py():
                        rows.append(row + i)
                        numbers.append(n)
                        content.append(own[n * BLOCK : (n + 1) * BLOCK + window - 1].tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(numbers, pa.int32()), pa.array(content, pa.binary())], names=["ref", "ref_row", "number", "content"])

    return run


def _of_row(hits, blocks) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, dict]:
    """The arguments of parse() from a row's lists."""
    at, ref, row, place = (hits.field(c).to_numpy() for c in ("at", "ref", "ref_row", "place"))
    order = np.argsort(at, kind="stable")
    keys = zip(blocks.field("ref").to_pylist(), blocks.field("ref_row").to_pylist(), blocks.field("number").to_pylist(), strict=True)
    held = {k: np.frombuffer(c, np.uint32) for k, c in zip(keys, blocks.field("content").to_pylist(), strict=True)}
    return at[order], list(zip(ref[order].tolist(), row[order].tolist(), strict=True)), place[order], held


def covered(n_words: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which words lie under factors."""
    depth = np.zeros(n_words + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + lengths, n_words), -1)
    return np.cumsum(depth[:-1]) > 0


def _parser(window: int, out: str):
    """A text's factors, or what they leave of it (text), or the digest of that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, blocks, result, removed = batch.column("hits"), batch.column("blocks"), [], []
            for row, end, w in tx.slices(batch.column("text")):
                h = _short(w.hashes())
                for i in range(end - row):
                    own = h[w.first[i] : w.first[i + 1]]
                    found = np.array(parse(own, *_of_row(hits[row + i].values, blocks[row + i].values), window), np.int64).reshape(-1, 4)
                    if out == "factors":
                        result.append(found)
                        continue
                    gone = covered(len(own), found[:, 0], found[:, 1])
                    removed.append(int(gone.sum()))
                    kept = _join(w, i, ~gone)
                    result.append(hashlib.sha256(kept).hexdigest() if out == "digest" else kept.decode())
            ids = [batch.column("doc_id"), batch.column("row_hash")]
            if out == "factors":
                size = np.array([len(x) for x in result])
                at = pa.array(np.repeat(np.arange(len(size)), size))
                flat = np.concatenate(result) if result else np.zeros((0, 4), np.int64)
                yield pa.RecordBatch.from_arrays([*[x.take(at) for x in ids], *[pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)]], names=["doc_id", "row_hash", "start", "length", "ref_doc_id", "ref_start"])
            else:
                yield pa.RecordBatch.from_arrays([*ids, pa.array(removed, pa.int64()), pa.array(result, pa.string())], names=["doc_id", "row_hash", "n_cut", "cut"])

    return run


def _bits(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the column mark of rows, two bits each, as packed bytes; at most MOST_BITS come to the driver, in chunks."""
    size = 1 << 16
    while size < min(16 * rows.count(), MOST_BITS):
        size *= 2
    places = rows.select(F.explode(F.array(*[m.bitwiseAND(F.lit(size - 1)) for m in (F.col("mark"), F.shiftrightunsigned("mark", 32))])).alias("place"))

    def pack(table: pa.Table) -> pa.Table:
        marked = np.zeros(CHUNK_BITS, bool)
        place = table.column("place").to_numpy()
        marked[place % CHUNK_BITS] = True
        return pa.table({"chunk": pa.array([int(place[0]) // CHUNK_BITS]), "bits": pa.array([np.packbits(marked).tobytes()])})

    chunks = places.distinct().groupBy(F.floor(F.col("place") / CHUNK_BITS).alias("c")).applyInArrow(pack, "chunk long, bits binary").collect()
    whole = np.zeros(max(size, CHUNK_BITS) // 8, np.uint8)
    for c in chunks:
        whole[c.chunk * CHUNK_BITS // 8 : (c.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(c.bits, np.uint8)
    return whole[: size // 8]


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of texts(doc_id, row_hash, text) that wanted(doc_id, row_hash) may name, before they are shuffled: none of those is missing, few others are left until the filter is full."""
    mark = F.xxhash64("doc_id", "row_hash").alias("mark")
    bits = texts.sparkSession.sparkContext.broadcast(_bits(wanted.select(mark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = bits.value, np.uint64(len(bits.value) * 8 - 1)
        for batch in batches:
            h = batch.column("mark").to_numpy().view(np.uint64)
            mask = np.ones(len(h), bool)
            for place in (h & last, (h >> np.uint64(32)) & last):
                mask &= (known[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 1
            yield batch.filter(pa.array(mask)).drop_columns(["mark"])

    return texts.select("doc_id", "row_hash", "text", mark).mapInArrow(run, "doc_id long, row_hash long, text string")


class Repeats:
    """The parse of docs(doc_id, text): summary, hits and texts.

    Null texts have no words. A row without id is neither reference nor cut.
    Rows of one id are judged apart, and not against each other; rows alike in
    id and text are judged once and returned as often as they occur. Only
    doc_id and text are read.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR):
        self.window = window
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
        self.summary = cut(rows.mapInArrow(_summary(window, anchor), "doc_id long, row_hash long, n_words long, digest string, anchors array<long>"))
        known = self.summary.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
        first = known.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
        self.known = known.join(first, "digest").select("doc_id", "row_hash", "anchors", (F.col("first_id") < F.col("doc_id")).alias("copy"))
        first_rows = cut(self.known.filter(~F.col("copy")).select("doc_id", "row_hash", "anchors").dropDuplicates(["doc_id", "row_hash"]))
        anchors = first_rows.select("doc_id", "row_hash", F.explode("anchors").alias("anchor"))
        # written down, so that the join deals both sides and can split a common anchor's rows
        shared = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
        names = known.groupBy("doc_id").agg((F.min("row_hash") == F.max("row_hash")).alias("alone"))
        wanted = anchors.join(shared, "anchor").groupBy("doc_id", "row_hash").agg(F.collect_list("anchor").alias("shared"))
        row = F.when(F.col("alone"), F.lit(0).cast("long")).otherwise(F.col("row_hash")).alias("row")
        self.wanted = cut(wanted.join(names, "doc_id").select("doc_id", "row_hash", row, "shared"))
        self.texts = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        seeds = _only(self.texts, self.wanted).join(self.wanted, ["doc_id", "row_hash"]).mapInArrow(_seeds(window, anchor), "doc_id long, row long, at int, one long, two int")
        index = seeds.groupBy("one", "two").agg(F.min(F.struct("doc_id", "row", "at")).alias("ref"), F.count("*").alias("n")).filter("n > 1")
        index = index.select("one", "two", F.col("ref.doc_id").alias("ref"), F.col("ref.row").alias("ref_row"), F.col("ref.at").alias("place"))
        self.hits = seeds.join(index, ["one", "two"]).filter("ref < doc_id").select("doc_id", "row", "at", "ref", "ref_row", "place")

    def _parsed(self, out: str, schema: str) -> DataFrame:
        key, block = ["doc_id", "row_hash"], ["ref", "ref_row", "number"]
        named = self.wanted.select(*key, "row")
        listed = self.hits.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "ref", "ref_row", "place")).alias("hits"))
        listed = cut(listed.join(named, ["doc_id", "row"]).select(*key, "hits"))
        needed = listed.select(*key, F.explode(F.array_distinct(F.transform("hits", lambda h: F.struct(h["ref"].alias("ref"), h["ref_row"].alias("ref_row"), F.floor(h["place"] / BLOCK).cast("int").alias("number"))))).alias("b")).select(*key, "b.*")
        of_text = needed.groupBy(F.col("ref").alias("doc_id"), F.col("ref_row").alias("row")).agg(F.collect_set("number").alias("numbers")).join(named, ["doc_id", "row"])
        of_text = cut(of_text.select(*key, "row", F.col("numbers").alias("wanted")))
        # only texts that hit, or are hit, are dealt out again
        texts = _only(self.texts, listed.select(*key).union(of_text.select(*key)))
        blocks = texts.join(of_text, key).mapInArrow(_blocks(self.window), "ref long, ref_row long, number int, content binary")
        fetched = needed.join(blocks, block).groupBy(*key).agg(F.collect_list(F.struct(*block, "content")).alias("blocks"))
        rows = texts.dropDuplicates(key) if out == "factors" else texts
        return rows.join(listed, key).join(fetched, key).mapInArrow(_parser(self.window, out), schema)

    def factors(self) -> DataFrame:
        """(doc_id, row_hash, start, length, ref_doc_id, ref_start), without the exact copies."""
        return self._parsed("factors", "doc_id long, row_hash long, start long, length long, ref_doc_id long, ref_start long")

    def cut_texts(self, digest: bool) -> DataFrame:
        """(doc_id, row_hash, n_cut, cut): what the parse leaves of each text that has a factor, or its SHA-256."""
        parts = self._parsed("digest" if digest else "text", "doc_id long, row_hash long, n_cut long, cut string")
        return parts.dropDuplicates(["doc_id", "row_hash"])

    def copies(self) -> DataFrame:
        """(doc_id, row_hash) of the texts that are whole copies of a document of smaller id."""
        return self.known.filter("copy").select("doc_id", "row_hash").distinct()


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256. Nulls, repeated rows and rows without id as in Repeats; an empty table gives an empty result."""
    r = Repeats(docs, window)
    key = ["doc_id", "row_hash"]
    out = r.summary.select(*key, "n_words", "digest").join(r.cut_texts(True), key, "left").join(r.copies().withColumn("whole", F.lit(True)), key, "left")
    removed, kept = _outcome(F.lit(hashlib.sha256(b"").hexdigest()), F.col("digest"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def _outcome(empty: Column, full: Column) -> tuple[Column, Column]:
    whole = F.coalesce("whole", F.lit(False))
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long")
    return removed, F.when(whole, empty).otherwise(F.coalesce("cut", full))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words removed: the same columns; text becomes the kept words, joined by one space, where words were removed, and stays as it is elsewhere.

    A text may become empty. n_chars, if there, follows the text. Null texts and
    rows without id stay as they are; repeated rows are cut alike and kept each;
    other columns may have any names; an empty table stays empty.
    """
    r = Repeats(docs, window)
    done = r.cut_texts(False).select("doc_id", "row_hash", "cut").unionByName(r.copies().select("doc_id", "row_hash", F.lit("").alias("cut")))
    id_, hash_, cut_ = (free_name(docs, n) for n in ("rlz_id", "rlz_hash", "rlz_cut"))
    done = done.select(F.col("doc_id").alias(id_), F.col("row_hash").alias(hash_), F.col("cut").alias(cut_))
    out = docs.join(done, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left")
    text = F.coalesce(F.col(cut_), F.col("text")).alias("text")
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(cut_).isNotNull(), F.length(cut_)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])
