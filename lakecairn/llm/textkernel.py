"""Vectorised text kernels shared by the corpus operators.

Everything here works on the flat UTF-8 buffer of an Arrow string column, a
bounded slice of documents at a time, so memory follows ``MAX_BYTES`` (or one
longest document), not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, unless one document is longer. Just under a power of two, as tables of powers are.
MAX_BYTES = (1 << 19) - (1 << 12)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: The white space that separates words (space, tab to carriage return).
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z only; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over batches, giving memory back when it ends: workers live on from stage to stage."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release()
        gc.freeze()  # what is left are modules, which the next task's end need not go through again

    return run


def release() -> None:
    """Give freed memory back to the system."""
    _powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, _INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(19, int(n).bit_length()))


def slices(col: pa.Array, max_bytes: int = MAX_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) over runs of documents; null counts as empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, width)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + max_bytes, "right")) - 1)
        yield first, last, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def prefix_hash(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running polynomial sums: span_hash() takes any span's hash from them."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_codes(seed)[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each document (n + 1 numbers)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACES[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def shingles(buf: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of ASCII-lower-cased text, document by document, and n + 1 bounds.

    A document with fewer than k words (but one at least) has one: the whole sequence.
    """
    low = LOWER[buf]
    start, end, first = words(low, off)
    h = span_hash(prefix_hash(low), start, end)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bound = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bound[-1]) - np.repeat(bound[:-1] - first[:-1], count)
    long = np.repeat(n >= k, count)
    out = np.zeros(len(at), np.uint64)
    mult = np.uint64(0xD6E8FEB86659FD93)
    if len(h):
        for i in range(k):
            out = out * mult + h[np.minimum(at + i, len(h) - 1)]
    for d in np.flatnonzero((n > 0) & (n < k)):
        v = np.uint64(0)
        for x in h[first[d] : first[d + 1]]:
            v = np.uint64((int(v) * int(mult) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[bound[d]] = v ^ np.uint64(int(n[d]) + 1)
    assert len(long) == len(out)
    return mix(out), bound


class HashIndex:
    """A fixed map from distinct 64-bit keys to small numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        todo, slot = np.arange(len(keys)), keys & self.mask
        while len(todo):
            free = self.values[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[todo[won]], values[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = keys & self.mask
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot = (slot[wrong] if len(slot) != len(wrong) else slot) + np.uint64(1) & self.mask
            found, here = self.values[slot], self.keys[slot] == keys[wrong]
            out[wrong] = found
            more = (found >= 0) & ~here
            wrong, slot = wrong[more], slot[more]
        return out
