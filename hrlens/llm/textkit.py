"""Vectorised text helpers for Arrow batches: a slice of documents is one byte buffer.

Words are ``[^\\x20\\x09-\\x0D]+``.  These separators are ASCII, so words can be cut on the UTF-8
bytes.  Hashes are 64-bit (polynomial over a random byte table, then a finaliser).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1_500_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _BASE, U)
        up[0] = U(1)
        down = np.full(size, _BASE_INV, U)
        down[0] = U(1)
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def give_back() -> None:
    """Returns freed memory of this process to the system: workers live on after a task, and what
    their allocators keep would add up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


#: Empties a cache that this process keeps from task to task, by the cache's name.
caches: dict[str, Callable[[], None]] = {}


def drop_caches(keeps: str | None = None) -> None:
    """Empties every cache but ``keeps``: a worker that goes on to another operator does not hold
    what the one before it kept."""
    for name in [x for x in caches if x != keeps]:
        caches.pop(name)()
        give_back()


def gives_back(run: Callable, keeps: str | None = None) -> Callable:
    """A batch function that gives memory back when its task ends, and starts without the caches of
    others (``keeps`` names its own)."""
    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        drop_caches(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


@dataclass
class Slice:
    """``data[offsets[i]:offsets[i + 1]]`` are the bytes of document ``i`` (null counts as empty)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a text column into runs of whole documents of about ``limit`` bytes (one at least)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield Slice(i, data[off[i]:off[j]], off[i:j + 1] - off[i])
        i = j


@dataclass
class Words:
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def words(s: Slice, lower: bool = False) -> Words:
    """Every word of the slice in order; ``lower`` folds A-Z before hashing."""
    data = _LOWER[s.data] if lower else s.data
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[s.offsets] = True
    solid = ~gap
    start = np.flatnonzero(solid[:-1] & (np.concatenate(([True], gap[:-2])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(solid[:-1] & (gap[1:] | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(s.offsets, start, side="right") - 1
    return Words(doc, start, end, span_hashes(data, start, end))


def rolling_windows(w: Words, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, index of the first word, hash) of every window inside one document, for each length
    from ``first`` to ``last``; a length adds one word's term to the sums of the one before."""
    h = np.zeros(len(w.hash), U)
    for k in range(1, last + 1):
        n = max(0, len(w.hash) - k + 1)
        h = h[:n]
        h += w.hash[k - 1:k - 1 + n] * _COEF[k - 1]
        if k >= first:
            at = np.flatnonzero(w.doc[:n] == w.doc[k - 1:k - 1 + n])
            yield k, at, mix(h[at] + U(k))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of ``k`` words inside one document."""
    if len(w.hash) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    last = len(w.hash) - k + 1
    at = np.flatnonzero(w.doc[:last] == w.doc[k - 1:])
    h = np.zeros(last, U)
    for t in range(k):
        h += w.hash[t:last + t] * _COEF[t]
    return at, mix(h[at] + U(k))


def shingle_sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased ``k``-word shingles as (doc, hash), sorted; a document with fewer
    words has its whole sequence as one shingle, one without words none."""
    w = words(s, lower=True)
    at, h = windows(w, k)
    doc = w.doc[at]
    count = np.bincount(w.doc, minlength=s.n)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        base = np.cumsum(count) - count
        extra = np.zeros(len(few), U)
        for t in range(k - 1):
            has = count[few] > t
            extra[has] += w.hash[base[few[has]] + t] * _COEF[t]
        extra = mix(extra + U(1000) + count[few].astype(U))
        doc, h = np.concatenate((doc, few)), np.concatenate((h, extra))
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    n = np.bincount(doc, minlength=s.n)
    b = np.cumsum(n)
    a = b - n
    for i in np.flatnonzero(n > 1):
        h[a[i]:b[i]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def long_list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list<long> column whose row ``i`` has ``counts[i]`` consecutive values."""
    off = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))
