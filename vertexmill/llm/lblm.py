"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token (a word of the vocabulary, the end of a text, or any
other word) from the two tokens before it: the sum of each one's vector through
a matrix of its place is compared with the token's vector, plus a bias. The
vocabulary holds all words from the smallest count on that leaves MOST_WORDS of
them at most. Other words share one token's probability by smoothed counts, so
token probabilities sum to one over the words of the training text and one
unseen word.

Training text is counted by Spark and the model is trained in numpy on all of
it, in ROUNDS parts. Documents, as token numbers, are dealt by a hash into
shards whose number follows from the count of tokens, and stand in a fixed order
there; each shard trains a copy, and the copies are averaged word by word,
weighted by the word's uses in the shard, in the order of the shards. So the
result does not depend on how the table is partitioned.

Scoring normalises in three steps over a tree of near words (group, group in the
group, word in that), each a batched matrix product and a softmax, and mixes the
result with the words' smoothed counts. A group's vector is the mean of its
words', weighted by their biases; it is not trained on its own. Counts of the
vocabulary are broadcast; those of other words are joined by shuffle. Words are
known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import cut

#: Words of the vocabulary at most, 150 bytes each on the driver and in each task; token numbers take 16 bits.
MOST_WORDS = 50_000
WIDTH = 16
ORDER = 2
NOISE = 32
BATCH = 4096
RATE = 0.08
ROUNDS = 2
#: Tokens of a training shard, about, and shards at most (shards grow beyond).
SHARD_TOKENS, MOST_SHARDS = 4_000_000, 4096
#: The model's share in the mixture with the words' smoothed counts, which sums to one as both do: where the tree's steps or two words of context mislead, a token loses a quarter of its probability at most against the counts.
SHARE = 0.25
#: Parts into which a copy of the model is cut for averaging.
BLOCKS = 256
END, OTHER = 0, 1
#: Stands for the end of a text among word hashes.
END_HASH = np.uint64(0xE5D0C0DE0E5D0C0D)


class Params(NamedTuple):
    """context, target: a vector a token; place: a matrix for each token before; bias: of each token."""

    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray

    def rows(self) -> np.ndarray:
        """A row a token: its two vectors and its bias."""
        return np.concatenate([self.context, self.target, self.bias[:, None]], 1)

    @classmethod
    def of_rows(cls, rows: np.ndarray, place: np.ndarray) -> Params:
        width = place.shape[-1]
        parts = rows[:, :width], rows[:, width : 2 * width], place, rows[:, -1]
        return cls(*[np.ascontiguousarray(x, np.float32) for x in parts])


def start(log_unigram: np.ndarray, width: int = WIDTH, order: int = ORDER) -> Params:
    rng, n = np.random.Generator(np.random.PCG64(7)), len(log_unigram)
    place = np.stack([np.eye(width, dtype=np.float32) / (k + 1) for k in range(order)])
    return Params(rng.normal(0, 0.1, (n, width)).astype(np.float32), rng.normal(0, 0.1, (n, width)).astype(np.float32), place, log_unigram.astype(np.float32).copy())


def contexts(classes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The classes of the tokens before each token, nearest first. Each text ends with END, and END stands before its start."""
    out = np.zeros((len(classes), order), np.int64)
    out[1:, 0] = classes[:-1]
    for k in range(1, order):
        out[1:, k] = np.where(out[1:, k - 1] == END, END, out[:-1, k - 1])  # nothing reaches across an end
    return out


def predict(p: Params, before: np.ndarray) -> np.ndarray:
    return sum(p.context[before[:, k]] @ p.place[k] for k in range(before.shape[1]))


def placed(p: Params) -> list[np.ndarray]:
    """Every token's vector through the matrix of each place."""
    return [p.context @ m for m in p.place]


def guesses(tables: list[np.ndarray], before: np.ndarray) -> np.ndarray:
    """As predict, from placed(p)."""
    out = tables[0][before[:, 0]]
    for k, table in enumerate(tables[1:], 1):
        out += table[before[:, k]]
    return out


class Trainer:
    """Adagrad on the noise-contrastive loss, in minibatches that share their noise."""

    def __init__(self, params: Params, log_noise: np.ndarray, noise: int = NOISE, rate: float = RATE, seed: int = 1):
        self.p = Params(*[x.copy() for x in params])
        self.seen = Params(*[np.full_like(x, 1e-2) for x in params])
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.log_noise, self.noise, self.rate = log_noise, noise, rate
        self.pick = np.cumsum(np.exp(log_noise))
        self.pick /= self.pick[-1]

    def _step(self, which: int, rows, grad: np.ndarray) -> None:
        seen, p = self.seen[which], self.p[which]
        seen[rows] += grad * grad
        p[rows] += self.rate * grad / np.sqrt(seen[rows])

    @staticmethod
    def _by_class(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        return index[first], np.add.reduceat(grad[order], first)

    def train(self, before: np.ndarray, target: np.ndarray) -> None:
        for i in range(0, len(target), BATCH):
            self._batch(before[i : i + BATCH], target[i : i + BATCH])

    def _batch(self, before: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        noise = np.searchsorted(self.pick, self.rng.random(self.noise))
        guess = predict(p, before)
        own = p.target[target]
        lift = math.log(self.noise)
        up = np.einsum("ij,ij->i", guess, own) + p.bias[target] - self.log_noise[target] - lift
        down = guess @ p.target[noise].T + (p.bias[noise] - self.log_noise[noise] - lift)
        up = 1 / (1 + np.exp(np.clip(up, -30, 30)))  # 1 - sigmoid
        down = -1 / (1 + np.exp(-np.clip(down, -30, 30)))
        scale = np.float32(1 / n)
        d_guess = (up[:, None] * own + down @ p.target[noise]) * scale
        rows, grad = self._by_class(np.concatenate([target, noise]), np.concatenate([up[:, None] * guess, down.T @ guess]) * scale)
        d_place = [p.context[before[:, k]].T @ d_guess for k in range(before.shape[1])]
        back = [d_guess @ p.place[k].T for k in range(before.shape[1])]
        self._step(1, rows, grad)
        rows, grad = self._by_class(np.concatenate([target, noise]), np.concatenate([up, down.sum(0)]) * scale)
        self._step(3, rows, grad)
        rows, grad = self._by_class(before.T.ravel(), np.concatenate(back))
        self._step(0, rows, grad)
        for k, g in enumerate(d_place):
            self._step(2, k, g)


class Tree:
    """Tokens in an order that puts near target vectors side by side, cut into runs, and these into runs of runs.

    A run's vector is the mean of its tokens' and its bias the log of the sum of
    their exponents, so that its score is near the log of the sum of theirs.
    """

    def __init__(self, p: Params):
        n = len(p.bias)
        self.order = _near_order(p.target.astype(np.float64), p.bias)
        fan = max(1, math.ceil(n ** (1 / 3)))
        self.leaf_edge = _edges(n, fan * fan)
        inner = len(self.leaf_edge) - 1
        self.inner_edge = _edges(inner, fan)
        # of each token: its place in the order, its run, and its run of runs
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.place = place
        self.run = (np.searchsorted(self.leaf_edge, place, "right") - 1).astype(np.int64)
        self.top = (np.searchsorted(self.inner_edge, self.run, "right") - 1).astype(np.int64)
        leaves = (p.target[self.order], p.bias[self.order])
        runs = _pooled(*leaves, self.leaf_edge)
        self.levels = (_pooled(*runs, self.inner_edge), runs, leaves)

    def log_probabilities(self, guess: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's normalised probability.

        In the tree's order the tokens of a run stand together, at every level,
        so each run's matrix product is over consecutive rows.
        """
        place = self.place[target]
        order = np.argsort(place.astype(np.uint16) if len(self.place) <= 1 << 16 else place, kind="stable")
        guess, place, target = guess[order], place[order], target[order]
        top, run = self.top[target], self.run[target]
        sums = np.zeros(len(target), np.float32)
        for (vectors, bias), edge, parent, child in zip(self.levels, (np.array([0, len(self.levels[0][1])]), self.inner_edge, self.leaf_edge), (np.zeros(len(target), np.int64), top, run), (top, run, place), strict=True):
            first = np.searchsorted(parent, np.arange(len(edge)))
            safe = np.sqrt((guess * guess).sum(1).max(initial=0) * (vectors * vectors).sum(1).max()) + np.abs(bias).max() < 80
            for k in np.flatnonzero(np.diff(first)).tolist():
                a, b = edge[k], edge[k + 1]
                if b - a == 1:
                    continue
                one, columns, offset = np.ones(b - a, np.float32), vectors[a:b].T.copy(), bias[a:b]
                for i in range(first[k], first[k + 1], STEP_ROWS):
                    j = min(i + STEP_ROWS, first[k + 1])
                    s = guess[i:j] @ columns
                    s += offset
                    if not safe:  # an exponent might not fit
                        s -= s.max(1, keepdims=True)
                    own = s[_COUNT[: j - i], child[i:j] - a]
                    np.exp(s, out=s)
                    sums[i:j] += own - np.log(s @ one)
        out = np.empty(len(target))
        out[order] = sums
        return out


#: Rows of a matrix product whose scores stay in the cache.
STEP_ROWS = 1 << 12
_COUNT = np.arange(STEP_ROWS)


def _edges(n: int, parts: int) -> np.ndarray:
    """Bounds of so many even runs of n, none empty."""
    return np.unique(np.arange(min(n, parts) + 1) * n // max(1, min(n, parts)))


def _pooled(vectors: np.ndarray, bias: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum.reduceat(bias, edge[:-1])
    weight = np.exp((bias - np.repeat(top, np.diff(edge))).astype(np.float64))
    total = np.add.reduceat(weight, edge[:-1])
    mean = np.add.reduceat(vectors * weight[:, None], edge[:-1]) / total[:, None]
    return mean.astype(np.float32), (top + np.log(total)).astype(np.float32)


def _near_order(vectors: np.ndarray, bias: np.ndarray, least: int = 8) -> np.ndarray:
    """Numbers of the vectors, halved again and again across the direction in which they spread most."""
    out, stack = [], [np.arange(len(vectors))]
    while stack:
        rows = stack.pop()
        if len(rows) <= least:
            out.append(rows[np.lexsort((rows, bias[rows]))])
            continue
        x = vectors[rows] - vectors[rows].mean(0)
        _, axes = np.linalg.eigh(x.T @ x)
        axis = axes[:, -1] * (1 if axes[np.abs(axes[:, -1]).argmax(), -1] > 0 else -1)
        rows = rows[np.lexsort((rows, x @ axis))]
        half = len(rows) // 2
        stack += [rows[half:], rows[:half]]
    return np.concatenate(out)


def mixed(log_model: np.ndarray, log_unigram: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Log of the mixture of both probabilities, the model's with this share."""
    return np.logaddexp(math.log(share) + log_model, math.log1p(-share) + log_unigram)


def log_probabilities(p: Params, before: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of each target token's normalised probability."""
    return Tree(p).log_probabilities(predict(p, before), target)


def _tokens(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, token hashes of these rows with each text's end) by slice of text."""
    for row, end, w in tx.slices(column, lower=True):
        rows = np.arange(row, end)
        h = w.hashes()
        size = np.diff(w.first)
        if wanted is not None:
            keep = wanted[row:end]
            h, rows, size = h[np.repeat(keep, size)], rows[keep], size[keep]
        ends = np.cumsum(size)
        yield rows, np.insert(h, ends, END_HASH)


def _classes(h: np.ndarray, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """place of each hash in sorted hashes, or -1."""
    if not len(hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, place[at], -1)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for _, h in _tokens(batch.column("text"), wanted):
            value, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Counts(NamedTuple):
    """Of the training tokens: their number, the distinct ones, the table (hash, n), and the vocabulary's part of it: hashes in order, and their counts."""

    tokens: int
    distinct: int
    table: DataFrame
    hashes: np.ndarray
    n: np.ndarray


def count(rows: DataFrame, most_words: int = MOST_WORDS) -> Counts:
    """The vocabulary are the words of the least count, in steps of 1/64 of a doubling, that leaves most_words at most; END is always in it."""
    table = cut(rows.select("held_out", "text").mapInArrow(_counting, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    step = F.floor(64 * F.log2("n")).cast("int")
    # a row a step, 64 * 63 at most
    steps = table.groupBy(step.alias("step")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    least, room = 0, most_words
    for r in sorted(steps, reverse=True):
        room -= r["words"]
        if room < 0:
            least = r["step"] + 1
            break
    end = int(END_HASH.astype(np.int64))
    hot = table.filter((step >= least) | (F.col("hash") == end)).collect()
    hashes, n = np.array([r[0] for r in hot], np.int64).view(np.uint64), np.array([r[1] for r in hot], np.int64)
    order = np.argsort(hashes)
    return Counts(sum(r["n"] for r in steps), sum(r["words"] for r in steps), table, hashes[order], n[order])


class Model(NamedTuple):
    params: Params
    #: sorted hashes of the vocabulary, END among them, and their token numbers
    hashes: np.ndarray
    classes: np.ndarray
    log_unigram: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        c = _classes(h, self.hashes, self.classes)
        return np.where(c < 0, OTHER, c)


def first_model(counts: Counts) -> Model:
    own = counts.hashes != END_HASH
    hashes, n = counts.hashes[own], counts.n[own]
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((hashes, -n))] = np.arange(len(n))
    ends = int(counts.n[~own].sum())
    weight = np.ones(2 + len(hashes))
    weight[2 + rank] += n
    weight[END] += ends
    # smoothed as its words are, so that the counts alone give each word the base score
    weight[OTHER] += counts.tokens - ends - n.sum() + counts.distinct - len(counts.hashes)
    log_unigram = np.log(weight / weight.sum())
    order = np.argsort(np.append(hashes, END_HASH))
    return Model(start(log_unigram), np.append(hashes, END_HASH)[order], np.append(2 + rank, END)[order], log_unigram.astype(np.float32))


def _numbers(sent):
    """Documents as token numbers of 16 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h in _tokens(batch.column("text")):
                stop = np.flatnonzero(h == END_HASH) + 1
                data = sent.value.of(h).astype(np.uint16).tobytes()
                first = [0, *(2 * stop).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("deal").take(pa.array(rows)), pa.array([data[i:j] for i, j in zip(first, first[1:], strict=False)], pa.binary())], names=["deal", "tokens"])

    return run


#: Bytes of token numbers that are trained on at once.
TRAIN_BYTES = 1 << 20


class _Copy:
    """A copy of the model, trained on one shard's documents as they come."""

    def __init__(self, model: Model, shard: int, turn: int):
        self.trainer, self.shard = Trainer(model.params, model.log_unigram, seed=1 + turn + 2 * shard), shard
        self.uses, self.held, self.size = np.zeros(len(model.log_unigram)), [], 0

    def add(self, tokens: bytes) -> None:
        self.held.append(tokens)
        self.size += len(tokens)
        if self.size >= TRAIN_BYTES:  # cut by the documents alone, not by the batches
            self.train()

    def train(self) -> None:
        c = np.frombuffer(b"".join(self.held), np.uint16).astype(np.int64)
        self.trainer.train(contexts(c), c)
        self.uses += np.bincount(c, minlength=len(self.uses))
        self.held, self.size = [], 0

    def blocks(self) -> pa.RecordBatch:
        """(block, shard, at, weights, average) of the tokens that the shard uses; block -1 holds the matrices."""
        if self.held:
            self.train()
        values, used = self.trainer.p.rows(), np.flatnonzero(self.uses)
        rows = [used[used % BLOCKS == k] for k in range(BLOCKS)]
        parts = [(k, at // BLOCKS, self.uses[at], values[at]) for k, at in enumerate(rows) if len(at)] + [(-1, np.zeros(1), np.array([self.uses.sum()]), self.trainer.p.place)]
        as_bytes = lambda x, kind: pa.array([np.ascontiguousarray(p[x], kind).tobytes() for p in parts], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([self.shard] * len(parts), pa.int32()), as_bytes(1, np.int32), as_bytes(2, np.float64), as_bytes(3, np.float32)], names=["block", "shard", "at", "weights", "average"])


def _training(sent, turn: int):
    """Copies of the model, one a shard, over rows sorted by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy = None
        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if copy is None or copy.shard != shard:
                    if copy is not None:
                        yield copy.blocks()
                    copy = _Copy(sent.value, shard, turn)
                copy.add(tokens)
        if copy is not None:
            yield copy.blocks()

    return run


def _average(table: pa.Table) -> pa.Table:
    """The mean of a block's rows over the shards that use them, summed in the shards' order."""
    table = table.sort_by("shard")
    at, weights, values = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]) for c, kind in (("at", np.int32), ("weights", np.float64), ("average", np.float32)))
    order = np.argsort(at, kind="stable")
    at, weights, values = at[order], weights[order], values.reshape(len(at), -1)[order].astype(np.float64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    total = np.add.reduceat(weights, first)
    mean = np.add.reduceat(values * weights[:, None], first) / total[:, None]
    return pa.table({"block": table.column("block").slice(0, 1), "at": pa.array([at[first].tobytes()], pa.binary()), "average": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train(rows: DataFrame, model: Model, tokens: int, rounds: int = ROUNDS) -> Model:
    """Train on the rows(doc_id, text, held_out) that are not held out; each document counts in one round. tokens: how many there are."""
    shards = max(1, min(MOST_SHARDS, -(-tokens // (rounds * SHARD_TOKENS))))
    dealt = rows.filter(~F.col("held_out")).select(F.xxhash64("doc_id", "text").alias("deal"), "text")
    context = rows.sparkSession.sparkContext
    for turn in range(rounds):
        sent = context.broadcast(model)
        numbers = dealt.filter(F.pmod("deal", F.lit(rounds)) == turn).mapInArrow(_numbers(sent), "deal long, tokens binary")
        shard = F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("int").alias("shard")
        ordered = numbers.select(shard, "deal", "tokens").repartition("shard").sortWithinPartitions("shard", "deal", "tokens")
        copies = ordered.mapInArrow(_training(sent, turn), "block int, shard int, at binary, weights binary, average binary")
        # as many numbers as the model has
        blocks = copies.groupBy("block").applyInArrow(_average, "block int, at binary, average binary").collect()
        rows_now, place = model.params.rows(), model.params.place
        for b in blocks:
            at, average = np.frombuffer(b["at"], np.int32), np.frombuffer(b["average"], np.float32)
            if b["block"] < 0:
                place = average.reshape(place.shape)
            else:
                rows_now[at.astype(np.int64) * BLOCKS + b["block"]] = average.reshape(len(at), -1)
        model = model._replace(params=Params.of_rows(rows_now, place))
        sent.unpersist()
    return model


def score(docs: DataFrame, rounds: int = ROUNDS, most_words: int = MOST_WORDS) -> DataFrame:
    """A row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty and have one token, the end. A null id counts as
    the empty string, which is not held out. Repeated rows are counted and
    scored each on its own. Without training documents every token is unseen.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = count(rows, most_words)
    model = train(rows, first_model(counts), counts.tokens, rounds)
    hot, plain = rows.sparkSession.sparkContext.broadcast((counts.hashes, counts.n)), rows.sparkSession.sparkContext.broadcast((model._replace(params=None), Tree(model.params), placed(model.params)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hashes, n), (model, tree, tables) = hot.value, plain.value
        log_n = np.append(np.log10(n + 1.0), 0.0)
        number = np.arange(len(hashes))
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for rows, h in _tokens(batch.column("text")):
                if not len(rows):
                    continue
                stop = np.flatnonzero(h == END_HASH) + 1
                first = np.r_[0, stop[:-1]]
                size = stop - first
                c = model.of(h)
                at = _classes(h, hashes, number)
                known, other = at >= 0, c == OTHER
                log_c = log_n[at]
                lbl = mixed(tree.log_probabilities(guesses(tables, contexts(c)), c), model.log_unigram[c]) / math.log(10)
                sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), log_c, np.where(other, log_c, 0.0), lbl, other.astype(np.int64))]
                row = ids[rows]
                yield _batch(row, row, size, *sums)
                rare = np.flatnonzero(~known)
                if len(rare):
                    m = len(rare)
                    zero, none = np.zeros(m), np.zeros(m, np.int64)
                    yield _batch(np.repeat(row, size)[rare], h[rare].view(np.int64), none, none, zero, zero, zero, none)

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    parts = numbered.mapInArrow(_with_ids(run), "row long, doc_id long, held_out boolean, hash long, size long, known long, log_c double, log_other double, lbl double, other long")
    # a document's own row is spread by its number, which is no word's hash; it has a size
    found = parts.join(counts.table, "hash", "left").withColumn("n", F.when(F.col("size") == 0, F.col("n")))
    log_c = F.coalesce(F.log10(F.col("n") + 1.0), F.lit(0.0))
    summed = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("size").alias("n_tokens"), (F.sum("known") + F.count("n")).alias("n_known"),
        F.sum(F.col("log_c") + log_c).alias("log_c"), F.sum(F.col("log_other") + log_c).alias("log_other"), F.sum("lbl").alias("lbl"), F.sum("other").alias("other"),
    )
    own = int(counts.n[np.isin(counts.hashes, model.hashes)].sum())
    rest = counts.tokens - own + counts.distinct - int(np.isin(model.hashes, counts.hashes).sum()) + 1
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * math.log10(counts.tokens + counts.distinct + 1)).alias("base_score"),
        (F.col("lbl") + F.col("log_other") - F.col("other") * math.log10(rest)).alias("score"),
    )


def _batch(row, hash_, size, known, log_c, log_other, lbl, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in (row, hash_, size, known, log_c, log_other, lbl, other)], names=["row", "hash", "size", "known", "log_c", "log_other", "lbl", "other"])


def _with_ids(run):
    """run's batches with doc_id and held_out beside the documents' own rows."""
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("row")[0].as_py() if batch.num_rows else 0
            for out in run(iter([batch])):
                at = pa.array(out.column("row").to_numpy() - start)
                own = pa.array(out.column("size").to_numpy() > 0)
                ids = pc.if_else(own, batch.column("doc_id").take(at), None)
                held = pc.if_else(own, batch.column("held_out").take(at), None)
                columns = {n: out.column(n) for n in out.schema.names} | {"doc_id": ids, "held_out": held}
                names = ["row", "doc_id", "held_out", "hash", "size", "known", "log_c", "log_other", "lbl", "other"]
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return inner
