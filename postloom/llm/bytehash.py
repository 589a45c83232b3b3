"""Vectorised hashing of words in a batch of UTF-8 texts, without a Python object per word.

Every byte is mapped to a random 64-bit value; a word's hash is the polynomial of its
values, read off running sums, so a batch costs a few numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29, _S32 = np.uint64(33), np.uint64(29), np.uint64(32)

_values = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Values of the bytes as they are, and with A-Z taken as a-z.
PLAIN = _values
FOLDED = _values.copy()
FOLDED[65:91] = _values[97:123]

#: True for bytes of words `[^\x20\x09-\x0D]+`.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: True for letters: a-z, A-Z and every byte of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 18), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S33)
    h *= _C1
    h ^= h >> _S29
    h *= _C2
    h ^= h >> _S32
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of texts i..j: starts and ends in `data`, the text of each (0-based) and `first`, where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD):
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.data, self.offsets = data[lo:hi], offsets - lo
        inside = kind[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before &= ~edge[:-1]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after &= ~edge[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.docs = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._sums: np.ndarray | None = None

    def hashes(self, values: np.ndarray = FOLDED, most: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first `most` bytes."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values[self.data] * _power("up", _BASE, n)[:n], out=self._sums[1:])
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        down = _power("down", _BASE_INVERSE, n + 1)
        return mix((self._sums[ends] - self._sums[self.starts]) * down[self.starts])


_SHINGLE = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    n = len(h)
    if not n:
        return h
    size = min(width, n)
    out = h[: n - size + 1] * _SHINGLE[0]
    for k in range(1, size):
        out = out + h[k : n - size + 1 + k] * _SHINGLE[k]
    if n < width:
        out = out + _SHINGLE[7] * np.uint64(n)
    out = mix(out)
    out.sort()
    return out if len(out) == 1 else out[np.concatenate(([True], out[1:] != out[:-1]))]
