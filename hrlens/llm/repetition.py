"""Operator 2: quality rules on repetition coverage.

One pass over whole texts.  Rolling hashes of word windows of several lengths mark repeated
windows inside each document; a window of ``n`` words can only repeat where its first ``n - 1``
words repeat, so every longer length looks at the survivors of the one before.  The measures are
the share of word characters of the whole text in lines that occurred earlier in the same document,
and the share inside windows that occurred earlier; the published limits hold for these.  What
windows cover outside of repeated lines is returned too (``fresh_dup_*``) and decides nothing.  A
text with more than ``SYMBOL_LIMIT`` markup symbols a word fails too.

Defined cases: a null or blank text has no words and fails the base rule; ties, repeated rows and
repeated ids are judged row by row; an empty table gives no rows; only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.llm.textkit import U, mix, rolling_windows, slices, span_hashes, words

# Published repetition limits (window length -> largest share of characters)
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOL_LIMIT = 0.1
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal key elsewhere, has an equal key before it) for keys in text order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    repeated, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    repeated[order[1:]] = same
    repeated[order[:-1]] |= same
    return repeated, later


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(s) -> dict[str, np.ndarray]:
    """Counts per document of one slice."""
    w = words(s)
    per_doc = lambda doc, weight=None: np.bincount(doc, weight, minlength=s.n).astype(np.int64)
    lead = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))
    chars = lead[w.end] - lead[w.start]
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[s.data])))
    out = {"n_words": per_doc(w.doc), "word_chars": per_doc(w.doc, chars),
           "n_symbols": symbols[s.offsets[1:]] - symbols[s.offsets[:-1]]}
    salt = mix(np.arange(s.n, dtype=U) + U(1))

    breaks = np.flatnonzero(s.data == 10)
    filled = s.offsets[:-1][np.diff(s.offsets) > 0]
    start = np.union1d(breaks + 1, filled)
    start = start[start < len(s.data)]
    doc = np.searchsorted(s.offsets, start, side="right") - 1
    stop = np.minimum(np.append(breaks, len(s.data))[np.searchsorted(breaks, start)], s.offsets[doc + 1])
    first = np.searchsorted(w.start, start)
    full = np.searchsorted(w.start, stop) > first
    start, stop, doc, first = start[full], stop[full], doc[full], first[full]
    _, later = _groups(mix(span_hashes(s.data, start, stop) + salt[doc]))
    out["n_dup_lines"] = per_doc(doc[later])
    line_chars = np.concatenate(([0], np.cumsum(chars)))
    inside = line_chars[np.searchsorted(w.start, stop)] - line_chars[first]
    out["dup_line_chars"] = per_doc(doc[later], inside[later])
    in_line = np.zeros(len(w.doc) + 1, np.int32)
    np.add.at(in_line, first[later], 1)
    np.add.at(in_line, np.searchsorted(w.start, stop[later]), -1)
    fresh = np.cumsum(in_line[:-1]) == 0

    alive = np.ones(len(w.doc), bool)
    for n, at, h in rolling_windows(w, 3, max(NGRAM_LIMITS)):
        use = alive[at]
        at, h = at[use], h[use]
        repeated, later = _groups(mix(h + salt[w.doc[at]]))
        alive = np.zeros(len(w.doc), bool)
        alive[at[repeated]] = True
        if n == 3:
            out["n_repeat_words"] = per_doc(w.doc[_covered(at[repeated], 3, len(w.doc))])
        if n in NGRAM_LIMITS:
            hit = _covered(at[later], n, len(w.doc))
            out[f"dup_{n}gram_chars"] = per_doc(w.doc[hit], chars[hit])
            hit &= fresh
            out[f"fresh_dup_{n}gram_chars"] = per_doc(w.doc[hit], chars[hit])
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
           *(f"{kind}dup_{n}gram_chars" for n in NGRAM_LIMITS for kind in ("", "fresh_"))]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch["text"]):
            found = measure(s)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][s.first:s.first + s.n], *(pa.array(found[c]) for c in _COUNTS)],
                names=["doc_id", *_COUNTS])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base counts, the repetition counts, ``base_failed`` and ``kept``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words")) & (F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars"))
    for n, limit in NGRAM_LIMITS.items():
        fine &= F.col(f"dup_{n}gram_chars") <= limit * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
