"""Whole texts as numpy arrays: words, their places and 64-bit hashes, many documents at a time.

A text is taken as its UTF-8 bytes. Both word rules of this subpackage split at ASCII bytes only, so bytes and
code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 that is True for word bytes: all but those in ``spans`` (both ends included)."""
    table = np.ones(256, bool)
    for low, high in spans:
        table[low : high + 1] = False
    return table


#: Words as [^\x20\x09-\x0D]+
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
#: Words as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, for lower-cased text
ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
        if size > 4 * CHUNK_BYTES:  # a very long text: don't keep tables of its size
            tables = _powers[0][:n], _powers[1][:n]
            _powers[0], _powers[1] = _powers[0][:1].copy(), _powers[1][:1].copy()
            return tables
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of several texts: ``starts`` and ``ends`` are byte places in ``data``; words of text i are first[i]:first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    found: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands; worked out once."""
        if self.found is not None:
            return self.found
        powers, inverses = _power_tables(len(self.data) + 1)
        running = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=running[1:])
        found = (running[self.ends] - running[self.starts]) * inverses[self.starts]
        self.found = mix(found + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return self.found

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def split(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]], A-Z lower-cased if asked."""
    if lower:
        data = _LOWER[data]
    inside = word_bytes[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True  # no word goes on from one text to the next
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edges[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edges[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows low:high of the column with their bytes and offsets, about ``most`` bytes at a time; every row once, in order."""
    data, offsets = raw(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
