"""Word cutting and tokenisation against plain regular expressions and the library."""
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hrlens.llm.textkit import shingle_sets, slices, words
from hrlens.llm.tokens import tokenizer

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAé .,\n\t ßÄ'1<|́", max_size=40), st.text(max_size=30)), max_size=6)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_slices(texts, limit):
    seen, names = [], {}
    for s in slices(pa.array(texts, pa.string()), limit):
        w = words(s)
        raw = s.data.tobytes()
        for d, a, b, h in zip(w.doc, w.start, w.end, w.hash):
            word = raw[a:b].decode()
            seen.append((s.first + d, word))
            assert names.setdefault(word, h) == h
    assert seen == [(i, x) for i, t in enumerate(texts) for x in _words(t)]
    assert len(set(names.values())) == len(names)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingle_sets(texts, k):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for s in slices(pa.array(texts, pa.string())):
        doc, h = shingle_sets(s, k)
        for i in range(s.n):
            w = _words((texts[i] or "").translate(fold))
            want = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
            assert (doc == i).sum() == len(want) == len(set(h[doc == i].tolist()))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_token_ids_equal_the_library(texts):
    coder = tokenizer()
    for s in slices(pa.array(texts, pa.string())):
        ids, n = coder.ids_of(s)
        want = [coder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == [x for y in want for x in y]


def test_token_ids_of_special_cases():
    coder = tokenizer()
    texts = ["I'll go. It's 3.5, ok... a.b, X.", "<|endoftext|> <|ENDOFTEXT|>. a<|startoftext|>b", "J̌, İ. ſ é.", "«à.» ×. ÷, É."]
    for s in slices(pa.array(texts)):
        ids, n = coder.ids_of(s)
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_token_cache_restarts(monkeypatch):
    import hrlens.llm.tokens as tk
    coder = tk.WordTokenizer()
    monkeypatch.setattr(tk, "CACHED_WORDS", 50)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(40)) for _ in range(8)]
    for t in texts:
        for s in slices(pa.array([t])):
            assert coder.ids_of(s)[0].tolist() == coder.library.encode(t, add_special_tokens=False).ids


def test_a_worker_drops_the_caches_of_the_operator_before():
    """The tokenizer and its words stay for the packing tasks of a worker, not for what follows them."""
    from hrlens.llm import textkit, tokens
    first = tokens.tokenizer()
    own = textkit.gives_back(lambda batches: iter([tokens.tokenizer()]), keeps=tokens.CACHE)
    assert list(own(iter(())))[0] is first
    assert list(textkit.gives_back(lambda batches: iter([len(tokens._loaded)]))(iter(()))) == [0]
    assert list(own(iter(())))[0] is not first
