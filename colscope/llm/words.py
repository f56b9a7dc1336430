"""Words of many texts at once, as flat numpy arrays over their UTF-8 bytes.

A word is a longest run of characters other than space and U+0009 to U+000D. All of these are ASCII, so
words can be cut in the bytes. Hashes are 64-bit; equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 21

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _table(fold: bool) -> np.ndarray:
    t = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        t[65:91] = t[97:123]
    return t


_BYTES, _FOLDED = _table(False), _table(True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and the last one ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n, at = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64, n + 1, at * 8)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each, never cutting a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a slice: bytes from ``start`` to ``end``; text i has the words first[i] to first[i+1]."""

    data: np.ndarray
    ends: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, fold: bool) -> np.ndarray:
        """A hash for each word; ``fold`` takes A-Z as a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _MULTIPLIER)]))
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        values = (_FOLDED if fold else _BYTES)[self.data[np.repeat(self.start, size) + place]]
        return mix(np.add.reduceat(values * powers[place], at) + size.astype(np.uint64))


def words(texts: pa.Array, separators: np.ndarray = SEPARATORS) -> Words:
    """Runs of bytes that are no separators, within each text."""
    data, ends = text_bytes(texts)
    inside = ~separators[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[ends] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return Words(data, ends, start, end, np.searchsorted(start, ends))


def shingles(w: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within a text, and the word it begins at."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9FB21C651E98DF25) + hashes[k : total - n + 1 + k]
    inside = np.ones(len(h), bool)
    for cut in range(1, n):  # runs that begin within n - 1 words of a text's end leave it
        late = w.first[1:] - cut
        late = late[(late >= w.first[:-1]) & (late < len(h))]
        inside[late] = False
    at = np.flatnonzero(inside)
    return mix(h[at]), at
