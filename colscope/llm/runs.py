"""Sorted runs of (key, id) pairs, packed for the exchange.

Tasks sort what they have gathered by key and send one binary row for each bucket of keys. Keys are stored
as differences and all numbers by byte planes, which Spark's shuffle compression shortens well.
"""

from __future__ import annotations

import numpy as np

#: Pairs that a task gathers before it sorts them and sends them on.
RUN_PAIRS = 1 << 20


def planes(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, their second bytes, and so on."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(dtype).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64, n), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
