"""Numpy scanning of whole texts, batch by batch, inside Spark tasks.

Operators of this subpackage receive Arrow batches from ``mapInArrow``. A batch is cut into
chunks of whole documents of about ``CHUNK_BYTES`` so that the working arrays stay small
whatever the length of the batch; a single longer document is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Arrays of 64-bit numbers about a chunk stay in the cache of a core.
CHUNK_BYTES = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C55 | 1
_U = np.uint64

#: Bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: A-Z to a-z, all other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        for key, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x = x * _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) of runs of whole rows."""
    raw, off = string_parts(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-item) array over the rows that ``off`` bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class Scan:
    """Words, lines and their hashes in one chunk of documents."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off, self.n = raw, off, len(off) - 1
        up, self._down = powers(len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=self.prefix[1:])
        inside = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = ~inside
        self.start = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        #: Word w of document d is in word_off[d] : word_off[d + 1].
        self.word_off = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.word_off))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans."""
        return mix((self.prefix[end] - self.prefix[start]) * self._down[start] + (end - start).astype(_U))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def windows(self, n: int) -> np.ndarray:
        """Indices of the words at which ``n`` words of one document begin."""
        m = len(self.start) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every line; a document of n newlines has n + 1 lines."""
        cut = np.flatnonzero(self.raw == 10)
        start = np.sort(np.concatenate([cut + 1, self.off[:-1]]), kind="stable")
        end = np.sort(np.concatenate([cut, self.off[1:]]), kind="stable")
        doc = np.repeat(np.arange(self.n), per_row(self.raw == 10, self.off) + 1)
        return start, end, doc


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of every n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * _U(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix(h)


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
