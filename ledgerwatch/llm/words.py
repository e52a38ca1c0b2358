"""Words of an Arrow text column as numpy arrays: spans, 64-bit hashes and rolling window hashes.

A word is ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: also ASCII punctuation separates words
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_CHUNK = 1 << 20  # bytes hashed at a time


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = np.asarray(x).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (null rows are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text; a longer text is a range of its own."""
    offsets = text_buffers(column)[1]
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, stop
        start = stop


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are sorted and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        part = data[base : ends[j - 1]]
        up, down = _BYTES.get(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``data``, hashes, and the row of each."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, weights=None) -> np.ndarray:
        return np.bincount(self.rows, weights, minlength=self.n_rows)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and rolling hash of every window of ``n`` words inside one text."""
        total = len(self.rows)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.rows[: total - n + 1] == self.rows[n - 1 :])
        up, down = _WORDS.get(total + 1)
        prefix = np.zeros(total + 1, np.uint64)
        np.cumsum(self.hashes * up[:total], out=prefix[1:])
        return first, mix((prefix[first + n] - prefix[first]) * down[first])


def words_of(column: pa.Array, lower: bool = False, blank: np.ndarray = BLANK) -> Words:
    """Words of a text column; ``lower`` folds A-Z first, ``blank`` marks the separating bytes."""
    data, offsets = text_buffers(column)
    if lower:
        data = fold(data)
    solid = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text always ends the word before it
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, solid
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = solid, False
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, offsets, starts, ends, rows, span_hashes(data, starts, ends))


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    # few keys repeat: a bit table on 20 bits of the hash leaves few to look up
    table = np.zeros(1 << 20, bool)
    table[(twice >> np.uint64(44)).astype(np.int64)] = True
    out = table[(keys >> np.uint64(44)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
    out[maybe] = twice[at] == keys[maybe]
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for many values faster than the hash table of ``np.unique``."""
    keys = np.sort(keys)
    keep = np.ones(len(keys), bool)
    keep[1:] = keys[1:] != keys[:-1]
    return keys[keep]


def by_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one row."""
    return mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(0x51ED27)))
