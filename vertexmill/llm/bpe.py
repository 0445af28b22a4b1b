"""BPE encoding and decoding with a pair occurrence index.

Texts are cut into pre-tokens; the distinct new ones of a batch are encoded
together. An index maps each pair of neighbouring symbols to all its places in
the batch. Ranks are applied in ascending order: all places of the pair of the
lowest active rank are merged, left to right, and the lists of the pairs that
this breaks or makes are updated. Pre-tokens are numbered; a worker keeps the
ids of those it has met, up to a bounded number, in one flat array, so that
common ones are encoded once. A batch's ids, their decimals and the bytes that
they stand for are gathered by these numbers.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that a worker keeps before it starts afresh.
KEPT_WORDS = 300_000
#: The rank of pairs that do not merge.
NONE = 1 << 40
#: Bytes of text that are encoded together.
BATCH_BYTES = 4 << 20

_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-token pattern of byte-level BPE, with Unicode white space spelled out.
PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_S}\\p{{L}}\\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_PRETOKEN = regex.compile(PATTERN)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable in Latin-1, else the next free letter from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Runs:
    """Byte strings or arrays one behind the other: run k is flat[start[k] : start[k] + size[k]]."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of(cls, parts: list[bytes]) -> Runs:
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts)))

    def take(self, which: np.ndarray) -> Runs:
        """The runs of these numbers, one behind the other."""
        size = self.size[which]
        out = Runs(self.flat[:0], size)
        shift = (self.start[which] - out.start).astype(np.int32)
        at = np.arange(int(size.sum()), dtype=np.int32)
        at += np.repeat(shift, size)
        out.flat = self.flat[at]
        return out

    def bounds(self, runs: np.ndarray) -> np.ndarray:
        """Where the flat values of each of so many runs in turn begin, with the end of the last."""
        return np.append(self.start, len(self.flat))[np.concatenate([[0], np.cumsum(runs)])]


class Vocabulary:
    """Merges, symbols and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.width = max(vocab.values()) + 2
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        sides = np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        keys = sides[:, 0] * self.width + sides[:, 1]
        self.key_ranks = np.argsort(keys)
        self.keys = keys[self.key_ranks]
        self.twins = (sides[:, 0] == sides[:, 1]).tolist()
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(of_letter[c] for c in token) for token, i in vocab.items() if all(c in of_letter for c in token)}
        self.token_bytes |= {i: token.encode() for token, i in self.special.items()}
        known = range(max(self.token_bytes, default=-1) + 1)
        self.bytes = Runs.of([self.token_bytes.get(i, b"") for i in known])
        self.decimals = Runs.of([f"{i},".encode() for i in known])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()

    def forget(self) -> None:
        """Keep the special tokens alone."""
        self.words = {t: k for k, t in enumerate(self.special)}
        self.ids = Runs(np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    def ranks_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they do not merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, and the number of each.

        symbol, after and before are a linked list over the places; rank holds
        the rank of the pair that starts at a place. places is the index: the
        places that a pair has had, by rank. A place counts while its rank is
        still the pair's.
        """
        if not pretokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        symbol = np.insert(self.first[np.frombuffer(b"".join(pretokens), np.uint8)], np.cumsum(size), self.width - 1)  # an end that pairs with nothing
        n = len(symbol)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.append(self.ranks_at(symbol[:-1], symbol[1:]), NONE)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            own = rank[at]
            at = at[own < NONE]
            own = own[own < NONE]
            if not len(at):
                return
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            firsts = own[edges[:-1]].tolist()
            for r, i, j in zip(firsts, edges, edges[1:], strict=False):
                if r in places:
                    places[r].append(at[i:j])
                else:
                    places[r] = [at[i:j]]
                    heapq.heappush(active, r)

        enter(np.arange(n - 1))
        while active:
            r = heapq.heappop(active)
            found = places.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank[at] == r]
            if self.twins[r]:
                at = _apart(at, after)
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            symbol[at] = self.made[r]
            rank[gone] = NONE
            symbol[gone] = -1
            after[at] = behind
            before[behind] = at
            ahead = before[at]
            changed = np.concatenate([at, ahead[ahead >= 0]])
            if len(changed) > 1:
                changed = np.unique(changed)
            rank[changed] = self.ranks_at(symbol[changed], symbol[after[changed]])
            enter(changed)
        left = symbol[symbol >= 0]
        ends = np.flatnonzero(left == self.width - 1)
        return left[left != self.width - 1], np.diff(ends, prepend=-1) - 1

    def learn(self, new: list[str]) -> None:
        """Encode pre-tokens, number them and keep them."""
        ids, n = self.merge([p.encode() for p in new])
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.ids = Runs(np.concatenate([self.ids.flat, ids.astype(np.int32)]), np.concatenate([self.ids.size, n]))

    def pieces(self, text: str) -> list[str]:
        """A text's pre-tokens, special tokens among them."""
        if self.cut and (found := self.cut.findall(text)):
            out: list[str] = []
            for part, token in zip(self.cut.split(text), [*found, None], strict=True):
                out.extend(_PRETOKEN.findall(part))
                if token is not None:
                    out.append(token)
            return out
        return _PRETOKEN.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, with the end of the last."""
        if len(self.words) > KEPT_WORDS:
            self.forget()
        parts = [self.pieces(t) for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        del parts
        new = [p for p in set(flat) if p not in self.words]
        if new:
            self.learn(new)
        found = self.ids.take(np.fromiter(map(self.words.__getitem__, flat), np.int32, len(flat)))
        return found.flat, found.bounds(size)

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; ids outside the vocabulary are left out."""
        return b"".join(self.token_bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Places of a pair of equal symbols, left to right, without those that share a symbol with the one before."""
    kept, taken = [], -1
    for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
        if i != taken:
            kept.append(i)
            taken = j
    return np.array(kept, np.int64)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _texts(batch: pa.RecordBatch) -> Iterator[list[str]]:
    return _groups(batch.column("text").fill_null("").to_pylist())


def report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row per row of docs(doc_id, text).

    Null texts count as empty: no ids, an empty decoded text. Repeated rows and
    null ids are encoded like any other; an empty table gives an empty result. A
    special token's string in a text becomes its id, as in the library, and is
    decoded to its string. Texts are encoded BATCH_BYTES at a time, a longer text
    alone. Other columns are not read. path names the tokenizer file on every
    worker.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        gc.freeze()  # what is kept holds no cycles; it need not be traversed again and again
        for batch in batches:
            n, ids, decoded = [], [], []
            for group in _texts(batch):
                flat, first = v.encode(group)
                size = np.diff(first)
                n.extend(size.tolist())
                decimals, data = v.decimals.take(flat), v.bytes.take(flat)
                ids.extend(_digest(x[:-1]) for x in _split(decimals, size))
                decoded.extend(_digest(_valid(x)) for x in _split(data, size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _split(runs: Runs, size: np.ndarray) -> Iterator[bytes]:
    """The bytes of so many runs in turn, for each text."""
    data, first = runs.flat.tobytes(), runs.bounds(size).tolist()
    return (data[i:j] for i, j in zip(first, first[1:], strict=False))


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _valid(data: bytes) -> bytes:
    return data.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>), a row per row of docs; null texts have no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for group in _texts(batch):
                ids, first = v.encode(group)
                flat.append(ids)
                size.append(np.diff(first))
            size = np.concatenate(size)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), ids], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
