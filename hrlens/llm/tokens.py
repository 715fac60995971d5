"""Fast exact tokenisation of Arrow text batches with a public word-level tokenizer.

The tokenizer drops white space, so a text's ids are the concatenation of its words' ids.  Every
distinct word is encoded once per process: new words of a slice go through the library in one
string, with a special token between them as separator.  Two shortcuts keep the set of distinct
words small and do not change ids: words of ASCII and Latin-1 letters are folded in A-Z (the
tokenizer lower-cases; other scripts may compose differently), and one full stop or comma after an
ASCII letter or digit or a Latin-1 letter is a token of its own.
"""

from __future__ import annotations

import os

import numpy as np

from hrlens.llm.textkit import Slice, U, _LOWER, caches, give_back, span_hashes, words

VOCABULARY = "word_bpe_49k.json"
SEPARATOR = "<|startoftext|>"
CACHED_WORDS = 1_500_000
JOINED = 1000
_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
CACHE = "word tokenizer"
_loaded: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(path)
        self.separator = self.library.token_to_id(SEPARATOR)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, U)      # sorted word hashes
        self.slot = np.zeros(0, np.int32)  # their place in starts and counts
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each word, through the library."""
        out: list[list[int]] = []
        for i in range(0, len(texts), JOINED):
            part = texts[i:i + JOINED]
            if any("<|" in x or x == "" for x in part):
                out += [e.ids for e in self.library.encode_batch(part, add_special_tokens=False)]
                continue
            ids = np.array(self.library.encode(SEPARATOR.join(part), add_special_tokens=False).ids)
            cut = np.flatnonzero(ids == self.separator)
            out += [x.tolist() for x in np.split(ids, cut)]
            for j in range(len(out) - len(part) + 1, len(out)):
                out[j] = out[j][1:]
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.known) + len(hashes) > CACHED_WORDS and len(self.known):
            raise OverflowError
        got = self.encode(texts)
        counts = np.array([len(x) for x in got], np.int32)
        base = len(self.ids)
        self.starts = np.concatenate((self.starts, base + np.cumsum(counts, dtype=np.int64) - counts))
        self.ids = np.concatenate((self.ids, np.array([t for x in got for t in x], np.uint32)))
        place = np.searchsorted(self.known, hashes)  # both sorted
        self.slot = np.insert(self.slot, place, len(self.counts) + np.arange(len(hashes), dtype=np.int32))
        self.known = np.insert(self.known, place, hashes)
        self.counts = np.concatenate((self.counts, counts))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.slot[i], self.known[i] == hashes

    def ids_of(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, ids per document)."""
        w = words(s)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(s.n, np.int64)
        odd = (s.data >= 0xC4) | (s.data == 0x3C)
        count = np.concatenate(([0], np.cumsum(odd)))
        plain = count[w.end] == count[w.start]
        low = _LOWER[s.data]
        last = s.data[w.end - 1]
        long = w.end - w.start > 1
        before = s.data[np.maximum(w.end - 2, 0)]
        lead = s.data[np.maximum(w.end - 3, 0)]
        letter = _LETTER_OR_DIGIT[before] | ((w.end - w.start > 2) & (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        tail = long & letter & ((last == 0x2E) | (last == 0x2C)) & plain
        times = 1 + tail.astype(np.int64)
        at = np.repeat(np.arange(len(w.start)), times)
        second = np.zeros(len(at), bool)
        second[np.cumsum(times)[tail] - 1] = True
        start = np.where(second, w.end[at] - 1, w.start[at])
        end = np.where(second, w.end[at], w.end[at] - tail[at])
        kind = plain[at]
        hashes = np.where(kind, span_hashes(low, start, end), span_hashes(s.data, start, end) ^ U(0x5555))
        uniq, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place, have = self._places(uniq)
        if not have.all():
            new = np.flatnonzero(~have)
            raw, folded = s.data.tobytes(), low.tobytes()
            texts = [(folded if kind[j] else raw)[start[j]:end[j]].decode() for j in first[new].tolist()]
            try:
                self._learn(uniq[new], texts)
            except OverflowError:  # start again with this slice's words
                self._clear()
                self._learn(uniq, [(folded if kind[j] else raw)[start[j]:end[j]].decode() for j in first.tolist()])
            place, _ = self._places(uniq)
        place = place[back]
        n = self.counts[place].astype(np.int64)
        at_id = np.arange(int(n.sum())) + np.repeat(self.starts[place] - (np.cumsum(n) - n), n)
        return self.ids[at_id], np.bincount(w.doc[at], n, minlength=s.n).astype(np.int64)


def tokenizer(path: str | None = None) -> WordTokenizer:
    """The process's tokenizer for a vocabulary file."""
    key = path or VOCABULARY
    if key not in _loaded:
        _loaded[key] = WordTokenizer(path)
        give_back()   # parsing the file takes twice what stays
    caches[CACHE] = _loaded.clear
    return _loaded[key]
