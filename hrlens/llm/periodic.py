"""Operator 11: periodic runs of words, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal),
at least ``MIN_EXPONENT * q`` and ``min_words`` words long, that no neighbouring word extends.

* Periods below ``BASE`` come from the highly periodic regions: word ``i`` is compared with word
  ``i + q`` for each of these few ``q``.
* Periods ``tau <= q < 2 tau`` (``tau = BASE, 2 BASE, ...``) come from the synchronising set of scale
  ``tau``: position ``i`` belongs to it when the smallest hash among the windows of ``tau`` words
  that start at ``i .. i + tau`` is at ``i`` or at ``i + tau``.  Membership depends on the ``2 tau``
  words after ``i`` only, so inside a run a member at ``i`` implies one at ``i + q`` with the same
  context, and these two are neighbours among the members with that context.  Windows whose own
  period is at most ``tau / 4`` have no hash: they lie in runs that smaller scales have found.  Any
  ``tau`` neighbouring positions hold a member unless all their windows are of that kind, which
  inside a run of smallest period ``q >= tau`` cannot be (Fine and Wilf); a run of four periods has
  room for both contexts, so every run is proposed.
* Every proposal is extended on the exact word numbers, so hashes decide no result.  A stretch found
  with a multiple of its period is dropped: the true period gave the same stretch.

Documents are independent: one pass, no shuffle; a slice of documents is worked on as one array with
a distinct separator after each.

Defined cases: a null text, or one without words, has no runs and the collapsed text ``""``; null,
repeated or tied ids do not matter, each row is judged by itself; an empty table gives no rows; only
the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.llm.textkit import _SEP, Slice, U, mix, slices, words

MIN_WORDS = 6
MIN_EXPONENT = 4      # the proof above needs at least four periods
BASE = 8              # smaller periods are compared directly
_NONE = U(2**64 - 1)
_STEP = U(0x9E3779B97F4A7C15)

OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of its halves."""
    return mix(left * _STEP + mix(right + _STEP))


def _stretches(a: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ``[start, end)`` with period ``q`` and at least ``least >= 2 q`` entries."""
    if len(a) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(a) - q + 2, np.int8)
    same[1:-1] = a[:-q] == a[q:]
    turn = np.flatnonzero(np.diff(same))
    start, end = turn[::2], turn[1::2] + q
    long = end - start >= least
    return start[long], end[long]


def _members(h: np.ndarray, tau: int) -> np.ndarray:
    """Positions of the synchronising set for window hashes ``h`` (``_NONE``: no hash)."""
    n = len(h) - tau          # positions with the windows i .. i + tau
    low, width = h, 1
    while width < tau:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:-1], low[1:])[:n]
    return np.flatnonzero((low != _NONE) & ((h[:n] == low) | (h[tau:] == low)))


def _extend(a: np.ndarray, first: int, last: int, q: int, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal stretches of period ``q`` around positions ``at`` of the document ``a[first:last]``."""
    differ = np.flatnonzero(a[first:last - q] != a[first + q:last]) + first
    j = np.searchsorted(differ, at)
    edge = np.concatenate(([first - 1], differ, [last - q]))
    return sorted({(int(s), int(e), q) for s, e in zip(edge[j] + 1, edge[j + 1] + q)})


def find_runs(a: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows ``start, end, period`` (by start, then period) of all runs of the documents
    ``a[first[d]:last[d]]``; entry ``last[d]`` is a value that occurs nowhere else."""
    runs: list[tuple[int, int, int]] = []
    size = last - first
    most = int(size.max()) if len(size) else 0
    for q in range(1, min(BASE, most // MIN_EXPONENT + 1)):
        start, end = _stretches(a, q, max(min_words, MIN_EXPONENT * q))
        runs += [(s, e, q) for s, e in zip(start.tolist(), end.tolist())]
    at = np.arange(len(a))
    h = mix(a.astype(np.int64).view(U))
    width, tau = 1, BASE
    while MIN_EXPONENT * tau <= most:
        inside = np.repeat(size >= MIN_EXPONENT * tau, size + 1)[at]  # at: places in the slice that still matter
        at, h = at[inside], h[inside]
        while width < tau:
            h = _join(h[:-width], h[width:])
            width *= 2
        at = at[:len(h)]
        plain = np.zeros(len(a) + 1, np.int32)
        for s, e, q in runs:
            if 4 * q <= tau <= e - s:
                plain[s] += 1
                plain[e - tau + 1] -= 1
        busy = np.cumsum(plain[:-1])[at] > 0
        found = _members(np.where(busy, _NONE, h), tau) if len(h) > 2 * tau else np.zeros(0, np.int64)
        found = found[found + tau < len(h)]
        context = _join(h[found], h[found + tau])
        order = np.argsort(context, kind="stable")
        found, context = found[order], context[order]
        gap = found[1:] - found[:-1]
        pair = np.flatnonzero((context[1:] == context[:-1]) & (gap >= tau) & (gap < 2 * tau))
        if len(pair):
            place, period = at[found[pair]], gap[pair]
            doc = np.searchsorted(first, place, side="right") - 1
            key = doc * (2 * tau) + period
            order = np.lexsort((place, key))
            cut = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(order, cut):
                d, q = int(doc[group[0]]), int(period[group[0]])
                runs += [r for r in _extend(a, int(first[d]), int(last[d]), q, place[group])
                         if r[1] - r[0] >= max(min_words, MIN_EXPONENT * q)]
        tau *= 2
    if not runs:
        return np.zeros((0, 3), np.int64)
    least: dict[tuple[int, int], int] = {}
    for s, e, q in runs:
        least[s, e] = min(q, least.get((s, e), q))
    return np.array(sorted(((s, e, q) for (s, e), q in least.items()), key=lambda r: (r[0], r[2])), np.int64)


def _number(s: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, bytes of all words one after another, their offsets); equal words have
    equal numbers."""
    letters = s.data[~_SEP[s.data]]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64), letters, offsets


def _collapse(letters: np.ndarray, offsets: np.ndarray, doc: np.ndarray, kept: np.ndarray, n: int) -> pa.Array:
    """Kept words of each document joined by one space."""
    w = np.flatnonzero(kept)
    size = offsets[w + 1] - offsets[w]
    same = np.zeros(len(w), np.int64)
    same[:-1] = doc[w[1:]] == doc[w[:-1]]
    end = np.cumsum(size + same)
    flow = np.full(int(end[-1]) if len(w) else 0, 32, np.uint8)
    to = np.arange(int(size.sum())) + np.repeat(end - same - np.cumsum(size), size)
    of = np.arange(int(size.sum())) + np.repeat(offsets[w] - (np.cumsum(size) - size), size)
    flow[to] = letters[of]
    total = np.bincount(doc[w], size + same, minlength=n).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(total)))
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(off), pa.py_buffer(flow)])


def _of_slice(s: Slice, min_words: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    w = words(s)
    count = np.bincount(w.doc, minlength=s.n).astype(np.int64)
    number, letters, offsets = _number(s, w.start, w.end)
    last = np.cumsum(count + 1) - 1
    first = last - count
    a = np.empty(len(number) + s.n, np.int64)
    a[last] = -1 - np.arange(s.n)
    a[np.arange(len(number)) + w.doc] = number
    runs = find_runs(a, first, last, min_words)
    doc = np.searchsorted(first, runs[:, 0], side="right") - 1 if len(runs) else np.zeros(0, np.int64)
    gone = np.zeros(len(a) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone[:-1])[np.arange(len(number)) + w.doc] == 0
    parts = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[doc]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
                                       names=["start", "length", "period"])
    off = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=s.n)))).astype(np.int32)
    return count, pa.ListArray.from_arrays(pa.array(off), parts), _collapse(letters, offsets, w.doc, kept, s.n)


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch["text"]):
                count, runs, text = _of_slice(s, min_words)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(s.first, s.n), pa.array(count), runs, text.cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``.

    ``runs`` are all runs (start and length in words, smallest period) by start, then period;
    ``collapsed`` is the text without the words that a run repeats after its first period.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_runs(min_words), OUT)
