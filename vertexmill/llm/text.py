"""Word hashing over Arrow batches, in numpy.

Words are the runs of bytes outside 0x20 and 0x09-0x0D; those bytes never occur
inside a longer UTF-8 sequence. A word's hash is a sum of random numbers of its
bytes times random numbers of their places, modulo 2**64, mixed; a window's
hash is a polynomial over its words' hashes. All tables come from fixed seeds,
so hashes agree between workers and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


class _Places:
    """Random multipliers by place, as many as the longest word so far needs."""

    def __init__(self, seed: int):
        self.seed, self.table = seed, _random(seed, 1 << 10)

    def first(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = _random(self.seed, 1 << int(n - 1).bit_length())
        return self.table


_BYTES = [_random(11, 256), _random(12, 256)]
_PLACES = [_Places(21), _Places(22)]
#: Odd, 3 modulo 8: differences of its powers have few factors of two.
_STEP = [np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD1342543DE82EF9B)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of consecutive texts: byte ranges, hashes, and each text's range of words.

    data: the texts' bytes; start, stop: of each word in data; first: index of
    each text's first word, with the number of words at the end.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(inside) + 1, bool)  # without a byte, no word
        if len(inside):
            edge[0] = inside[0]
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[-1] = inside[-1]
        for b in (bounds[1:-1],):  # a word ends with its text
            cut = b[(b > 0) & (b < len(inside))]
            cut = np.unique(cut[inside[cut] & inside[cut - 1]])
        at = np.flatnonzero(edge)
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        self.start, self.stop, self._inside = at[::2], at[1::2], inside
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.stop - self.start
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        value = _BYTES[which][self.data[self._inside]]
        value *= _PLACES[which].first(int(size.max()))[place]
        return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _STEP[which])

    def words(self, text: int) -> list[bytes]:
        """A text's words as bytes."""
        data, a, b = self.data.tobytes(), self.first[text], self.first[text + 1]
        return [data[i:j] for i, j in zip(self.start[a:b].tolist(), self.stop[a:b].tolist(), strict=True)]


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP ** 0..n-1 and the inverses, modulo 2**64."""
    step = int(_STEP[which])
    back = pow(step, -1, 1 << 64)
    out = []
    for base in (step, back):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def windows(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The hash of every k consecutive words; one fewer than k shorter than hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes), which)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words of these rows) over a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offset, offset[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield row, end, Words(raw[offset[row] : offset[end]], offset[row : end + 1] - offset[row], lower)
        row = end
