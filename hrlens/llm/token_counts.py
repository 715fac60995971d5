"""Operator 12: token counts by a two-tier lookup of pre-token lengths on the map side.

The tokenizer never merges across certain borders (before a run of spaces, around line ends), so a
text's count is the sum over the pieces between them, its pre-tokens.  A pre-token's length comes
from

1. a broadcast table of the corpus's frequent pre-tokens, else
2. the worker process's cache, else
3. the library, which fills the cache.

The table is made of all documents: each task reduces its texts to the counts of at most ``SUMMARY``
frequent pre-tokens (counts of entries that had to go are subtracted from the others, so what is
frequent stays), and these bounded summaries, not the pre-tokens, are added up.  The table only
decides speed: any table gives the same counts.

The borders are exact for a BPE model with identity normalisation, a leading space, byte fallback,
no user-defined pieces, and no piece with a space after another character or with a line end; for
any other model, and for texts that hold U+2581 (the model's own mark of a space), whole texts go
through the library.

Defined cases: a null text counts as empty and has no bytes and no tokens; null, repeated or tied
ids do not matter; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.llm.textkit import Slice, slices

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
TABLE = 32_768       # entries of the broadcast table, each of at most LONGEST bytes
SUMMARY = 8_192      # entries of one task's summary
CACHED = 300_000     # entries of a worker's cache, which starts again when full
LONGEST = 64         # bytes of a pre-token that the table or a cache keeps
MARK = "▁"
_SPACE, _LINE_END = 32, 10
_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """The library with the process's cache of pre-token lengths."""

    def __init__(self, path: str | None = None) -> None:
        import sentencepiece
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(VOCABULARY)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cuts = _separable(path)
        self.cache: dict[bytes, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)] if texts else []

    def lengths(self, pre_tokens: list[bytes]) -> list[int]:
        """Tokens of each pre-token, through the library.  It puts a space before every text, so a
        leading space is left out, and a pre-token after a line end is encoded with that line end."""
        texts, less = [], []
        for t in pre_tokens:
            text = t.decode()
            if text[0] == " ":
                texts.append(text[1:])
                less.append(-1 if len(text) == 1 else 0)
            elif text[0] == "\n":
                texts.append(text)
                less.append(1)
            else:
                texts.append("\n" + text)
                less.append(2)
        return [n - k for n, k in zip(self.whole(texts), less)]

    def cached(self, pre_tokens: list[bytes]) -> list[int]:
        got = [self.cache.get(t) for t in pre_tokens]
        new = [i for i, n in enumerate(got) if n is None]
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
        for i, n in zip(new, self.lengths([pre_tokens[i] for i in new])):
            got[i] = n
            if len(pre_tokens[i]) <= LONGEST and len(self.cache) < CACHED:
                self.cache[pre_tokens[i]] = n
        return got


def _separable(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as model_file
    model = model_file.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, how = model.normalizer_spec, model.trainer_spec
    kinds = model_file.ModelProto.SentencePiece
    plain = [p.piece for p in model.pieces if p.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN)]
    return (how.model_type == model_file.TrainerSpec.BPE and how.byte_fallback and not how.treat_whitespace_as_suffix
            and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces and all(p.type != kinds.USER_DEFINED for p in model.pieces)
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain))


def counter(path: str | None = None) -> PieceCounter:
    """The process's counter for a model file."""
    key = path or VOCABULARY
    if key not in _loaded:
        _loaded[key] = PieceCounter(path)
    return _loaded[key]


def pre_tokens(s: Slice) -> tuple[np.ndarray, pa.Array]:
    """(document of each pre-token, pre-tokens); every document that isn't empty gets the space that
    the library puts before it."""
    size = np.diff(s.offsets)
    full = np.flatnonzero(size > 0)
    data = np.insert(s.data, s.offsets[full], _SPACE)
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    first = s.offsets[full] + np.arange(len(full))
    space, end = data == _SPACE, data == _LINE_END
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | (end[1:] != end[:-1])
    cut[first] = True
    start = np.flatnonzero(cut)
    off = np.append(start, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data)])
    return full[np.searchsorted(first, start, side="right") - 1], column


def _thin(tokens: pa.Array, n: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray]:
    """The ``most`` largest counts, less the largest count that goes (Misra and Gries)."""
    if len(n) <= most:
        return tokens, n
    n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
    keep = np.flatnonzero(n > 0)
    return tokens.take(pa.array(keep)), n[keep]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    for batch in batches:
        for s in slices(batch["text"]):
            _, column = pre_tokens(s)
            column = column.filter(pc.less_equal(pc.binary_length(column), LONGEST))
            got = pc.value_counts(column)
            both = pa.table({"t": pa.concat_arrays([held, got.field("values")]),
                             "n": pa.concat_arrays([pa.array(n), got.field("counts").cast(pa.int64())])}).group_by("t").aggregate([("n", "sum")])
            held, n = _thin(both["t"].combine_chunks(), both["n_sum"].to_numpy(), 8 * SUMMARY)
    held, n = _thin(held, n, SUMMARY)
    yield pa.RecordBatch.from_arrays([held.cast(pa.binary()), pa.array(n)], names=["pre_token", "n"])


def frequent(docs: DataFrame, size: int = TABLE, text_col: str = "text") -> list[bytes]:
    """At most ``size`` pre-tokens that are frequent over all documents (at most ``LONGEST`` bytes
    each, so the list has a fixed bound)."""
    found = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_summaries, "pre_token binary, n long")
             .groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(size))
    return [bytes(r[0]) for r in found.collect()]


def _counts(path: str | None, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = counter(path)
        tokens, sizes = table.value
        known, sizes = pa.array(tokens, pa.large_binary()), np.array(sizes, np.int64)
        for batch in batches:
            for s in slices(batch["text"]):
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(s.first, s.n), pa.array(np.diff(s.offsets)), pa.array(_of_slice(s, coder, known, sizes))],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return run


def _of_slice(s: Slice, coder: PieceCounter, known: pa.Array, sizes: np.ndarray) -> np.ndarray:
    raw = s.data.tobytes()
    whole = np.zeros(s.n, bool)
    if not coder.cuts:
        whole[:] = True
    elif MARK.encode() in raw:
        whole[[i for i in range(s.n) if MARK.encode() in raw[s.offsets[i]:s.offsets[i + 1]]]] = True
    out = np.zeros(s.n, np.int64)
    if not whole.all():
        doc, column = pre_tokens(s)
        coded = column.dictionary_encode()
        distinct = coded.dictionary
        place = pc.index_in(distinct, value_set=known)
        n = np.zeros(len(distinct), np.int64)
        hit = place.is_valid().to_numpy(zero_copy_only=False)
        n[hit] = sizes[place.drop_null().to_numpy()]
        n[~hit] = coder.cached(distinct.filter(place.is_null()).to_pylist())
        out = np.bincount(doc, n[coded.indices.to_numpy()], minlength=s.n).astype(np.int64)
    at = np.flatnonzero(whole)
    out[at] = coder.whole([raw[s.offsets[i]:s.offsets[i + 1]].decode() for i in at.tolist()])
    return out


def count_tokens(docs: DataFrame, limit: int = LIMIT, table: int = TABLE, vocabulary: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; ``vocabulary`` is the model
    file, the packaged public one by default."""
    tokens = frequent(docs, table, text_col)
    coder = counter(vocabulary)
    sizes = coder.lengths(tokens) if coder.cuts else [0] * len(tokens)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, sizes))  # at most table * LONGEST bytes
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(_counts(vocabulary, shared), "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
