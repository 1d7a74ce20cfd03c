"""Vectorised byte, word and shingle hashes over Arrow batches of texts.

All hashes are polynomials in one odd multiplier modulo 2**64, taken from prefix sums, so that the
hash of any byte range costs two lookups. Equal byte ranges have equal hashes; different ones of
the lengths used here collide with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking value for each byte.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 and their inverses modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``SLICE_BYTES``."""
    raw, offsets = buffers(column)
    first, n = 0, len(column)
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Hashed:
    """Prefix sums of one slice; ``of(start, end)`` is the hash of each byte range."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on."""
        count = max(0, self.n - width + 1)
        return (self.sums[width : width + count] - self.sums[:count]) * self.down[:count]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and for each row the number of its first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, width: int = 3) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    A-Z are lower-cased. A text with fewer than ``width`` words has its whole word sequence as its
    one shingle; a text without words, or a null, has none.
    """
    for _, _, data, offsets in slices(column):
        start, end, first = words(data, offsets)
        if not len(start):
            yield from (np.zeros(0, np.uint64) for _ in range(len(offsets) - 1))
            continue
        word = mixed(Hashed(_LOWER[data]).of(start, end) + (end - start).astype(np.uint64))
        count = np.diff(first)
        joined = np.zeros(len(word), np.uint64)
        span = max(0, len(word) - width + 1)
        for k in range(width):
            joined[:span] = (joined[:span] + word[k : k + span]) * np.uint64(_BASE)
        joined = mixed(joined)
        for a, n in zip(first[:-1].tolist(), count.tolist(), strict=True):
            if n >= width:
                yield np.unique(joined[a : a + n - width + 1])
            elif n:
                short = np.uint64(n)
                for w in word[a : a + n]:
                    short = np.multiply(np.add(short, w, dtype=np.uint64), np.uint64(_BASE))
                yield mixed(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
