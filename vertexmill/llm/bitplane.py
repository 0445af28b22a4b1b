"""Token ids in bit-plane files.

A file holds the ids of consecutive documents. They are cut into blocks of a
fixed number of ids; a block is transposed into planes, one for each bit (or
byte) of its ids, and each plane is compressed with zstandard. At the end of
the file stands the chunk index: place, size and number of ids of each block
and plane, and the documents' ids and lengths.

    magic "BPL1" | planes of block 0 | planes of block 1 | ... | index (zstandard) | length of index, 8 bytes | magic

Files go to the shared checkpoint folder, through the file system that its URI
names. A task writes its file under a name of its own attempt and renames it
when it is whole; the same task run again makes the same file.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import checkpoint_dir, cut

MAGIC = b"BPL1"
BLOCK_IDS = 1 << 16
LEVEL = 3
#: Words in each of the two generations that a worker keeps.
KEPT_WORDS = 400_000


def planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block: bit k (byte k) of all ids, for each k that is in use."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range((top + 7) // 8)]
    bits = np.unpackbits(raw[:, : (top + 7) // 8], axis=1, bitorder="little")[:, :top]
    return [p.tobytes() for p in np.packbits(bits.T, axis=1, bitorder="little")]


def unplanes(parts: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The ids of a block from its planes."""
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(parts):
            raw[:, k] = np.frombuffer(p, np.uint8)
    elif parts:
        rows = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)
        bits = np.zeros((n, 8 * ((len(parts) + 7) // 8)), np.uint8)
        bits[:, : len(parts)] = np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T
        raw[:, : bits.shape[1] // 8] = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4").copy()


class PlaneWriter:
    """Writes ids and documents to a stream, a block at a time."""

    def __init__(self, out, kind: str = "bit", block: int = BLOCK_IDS):
        self.out, self.kind, self.block = out, kind, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.rest: list[np.ndarray] = []
        self.n_rest, self.at = 0, len(MAGIC)
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, stop, self.block):
            part = ids[i : min(i + self.block, stop)]
            packed = [self.zip.compress(p) for p in planes(part, self.kind)]
            self.index.append((self.at, len(part), [len(p) for p in packed]))
            for p in packed:
                self.out.write(p)
            self.at += sum(map(len, packed))
        self.rest = [ids[stop:]]
        self.n_rest = len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        flat = [[at, n, len(sizes), *sizes] for at, n, sizes in self.index]
        numbers = np.array([self.kind == "byte", len(flat), len(self.docs), *[x for row in flat for x in row]], "<i8")
        ids = np.array([0 if i is None else i for i, _ in self.docs], "<i8")
        known = np.array([i is not None for i, _ in self.docs], "<i8")
        sizes = np.array([n for _, n in self.docs], "<i8")
        index = self.zip.compress(b"".join(x.tobytes() for x in (numbers, ids, known, sizes)))
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads a file's chunk index, then blocks or documents."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END) or source.tell()
        tail = self._read(end - 12, 12)
        if tail[8:] != MAGIC or self._read(0, 4) != MAGIC:
            raise ValueError("not a bit-plane file")
        size = int.from_bytes(tail[:8], "little")
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(end - 12 - size, size)), "<i8")
        self.kind = "byte" if data[0] else "bit"
        n_blocks, n_docs = int(data[1]), int(data[2])
        at, self.index = 3, []
        for _ in range(n_blocks):
            n = int(data[at + 2])
            self.index.append((int(data[at]), int(data[at + 1]), data[at + 3 : at + 3 + n].tolist()))
            at += 3 + n
        self.doc_ids, self.known, self.sizes = (data[at + k * n_docs : at + (k + 1) * n_docs] for k in range(3))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, number: int) -> np.ndarray:
        at, n, sizes = self.index[number]
        data, unzip, parts = self._read(at, sum(sizes)), zstandard.ZstdDecompressor(), []
        for size in sizes:
            parts.append(unzip.decompress(data[:size]))
            data = data[size:]
        return unplanes(parts, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order, a block in memory at a time besides the document."""
        held, number = np.zeros(0, np.uint32), 0
        for doc_id, known, size in zip(self.doc_ids.tolist(), self.known.tolist(), self.sizes.tolist(), strict=True):
            parts = [held]
            have = len(held)
            while have < size:
                parts.append(self.block(number))
                have += len(parts[-1])
                number += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (doc_id if known else None), held[:size]
            held = held[size:]


class WordEncoder(dict):
    """Encodes texts with a tokenizer file, word by word: a dictionary from words, as bytes, to their ids, that encodes what it misses.

    The tokenizer's pre-tokens never hold white space, so a text's ids are its
    ASCII-white-space-separated words' ids in turn. Each worker keeps the ids
    of words that it has met, in two generations of bounded size. Words of
    plain Latin letters, digits and signs are lower-cased and cut here, and
    their parts go to the tokenizer's model; all others go through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[bytes, bytes] = {}
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            low = word.lower()
            if low.isalpha():  # ASCII letters only
                ids = self[low] if low != word else self._model(word.decode())
            elif b"<|" in word:
                ids = self._whole(word)
            elif _SIGNS.fullmatch(word):
                parts = _ASCII_PARTS.findall(low)
                ids = b"".join([self[p] for p in parts]) if len(parts) > 1 or low != word else self._model(word.decode())
            else:
                text = word.decode()
                if _PLAIN.fullmatch(text):
                    parts = _PARTS.findall(text.lower())
                    if len(parts) > 1 or parts[0] != text:
                        ids = b"".join([self[p.encode()] for p in parts])
                    else:
                        ids = self._model(word.decode("latin-1").translate(self.letters))
                else:
                    ids = self._whole(word)
        self[word] = ids
        return ids

    def _model(self, part: str) -> bytes:
        return np.array([t.id for t in self.tokenize(part)], "<u4").tobytes()

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.encode().split())), "<u4")


_SIGNS = re.compile(b"[!-~]+")
#: The word tokenizer's pre-token pattern, for lower-cased ASCII and in full.
_ASCII_PARTS = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Latin letters, digits and signs that lower-casing and composition leave one by one.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u0240]+")
_PARTS = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+")


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_ids(docs: DataFrame, path: str, end_id: int, kind: str = "bit", folder: str | None = None) -> DataFrame:
    """Encode docs(doc_id, text) and write the ids in ascending doc_id order; returns the manifest (part, file, n_docs, n_ids, start), a row a file.

    Each document's ids end with end_id. Null texts count as empty; null ids go
    first; rows of one id stand in the order of their texts' hashes. Other
    columns are not read. An empty table gives an empty manifest. start counts
    the ids in all files before.
    """
    folder = folder or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}.bpl"
        trial = f"{root}/.{name}.{context.taskAttemptId()}"
        writer = stream = None
        end = np.array([end_id], "<u4")
        n_ids = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text").fill_null("").to_pylist(), strict=True):
                x = encoder(path).encode(text)
                if writer is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(trial)
                    writer = PlaneWriter(stream, kind)
                writer.add(doc_id, np.concatenate([x, end]))
                n_ids += len(x) + 1
        if writer is not None:
            writer.close()
            stream.close()
            store.move(trial, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "row_hash").select("doc_id", "text")
    manifest = cut(placed.mapInArrow(run, "part long, file string, n_docs long, n_ids long"))
    # one row a file
    start = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", start)


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids array<int>) from the files of a manifest, ids as they were written and, on request, left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, root = fs.FileSystem.from_uri(file)
                with store.open_input_file(root) as source:
                    rows, held = [], 0
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), ids if with_ids else None))
                        start += len(ids)
                        held += len(ids) if with_ids else 64
                        if held > 1 << 20:
                            yield _rows(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, with_ids)

    files = manifest.repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc_id, start, n, crc, ids = zip(*rows, strict=True)
    columns = [pa.array(x, pa.int64()) for x in (doc_id, start, n, crc)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def report(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write docs' ids, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    return read_ids(write_ids(docs, path, end_id), with_ids=False)
