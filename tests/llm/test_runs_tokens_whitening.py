"""Operators 11 to 13 against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from hrlens.llm import periodic, queries, token_counts, whitening
from hrlens.llm.textkit import slices
from tests.llm.odd import documents, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- operator 11

def brute_runs(w, min_words=6):
    """All runs by comparing every word with the word q later, for every q."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(min_words, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def runs_of(texts):
    out = []
    for s in slices(pa.array(texts, pa.string())):
        count, runs, text = periodic._of_slice(s, 6)
        out += [(n, [(r["start"], r["length"], r["period"]) for r in rr], t) for n, rr, t in zip(count.tolist(), runs.to_pylist(), text.to_pylist())]
    return out


def periodic_text(rng, n):
    """Words with nested repetition, so that runs overlap, touch and contain each other."""
    w = []
    while len(w) < n:
        if w and rng.random() < 0.5:
            q = rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 24, 31, 33, 40])
            w += (w[-q:] * rng.randint(1, 6))[:rng.randint(1, 6 * q)]
        else:
            w += rng.choices("abc" if rng.random() < 0.5 else [f"w{i}" for i in range(40)], k=rng.randint(1, 20))
    return w


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = [periodic_text(rng, rng.choice([5, 30, 200, 900])) for _ in range(12)]
    words += [["a"] * k for k in (0, 1, 5, 6, 7, 31, 32, 33, 64, 200)] + [["a", "b"] * 100, (["a"] * 9 + ["b"]) * 20, ["x"] + list("abcdefgh") * 4]
    got = runs_of([" ".join(w) for w in words])
    for w, (n, runs, text) in zip(words, got):
        assert n == len(w)
        assert runs == brute_runs(w)
        assert text == collapse(w, runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n", max_size=120), st.text(alphabet="aé\t b", max_size=60)), max_size=5))
def test_runs_of_any_text(texts):
    for t, (n, runs, text) in zip(texts, runs_of(texts)):
        w = WORD.findall(t or "")
        assert (n, runs, text) == (len(w), brute_runs(w), collapse(w, brute_runs(w)))


def test_long_periods_are_found():
    rng = random.Random(5)
    for q in (8, 63, 64, 65, 500, 1023, 1024):
        unit = [f"w{rng.randrange(50)}" for _ in range(q)]
        w = ["s1", "s2"] + (unit * 5)[:4 * q + q // 3] + ["e"]
        (_, runs, _), = runs_of([" ".join(w)])
        assert [r for r in runs if r[2] == q] and max(runs, key=lambda r: r[1])[2] == q


def planted(i, text):
    w = WORD.findall(text or "")
    if i is None:
        return w
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_periodic_query_equals_brute_force(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"], "en", "a") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows += [x for x in odd_rows() if len(x[1] or "") < 1000]
    monkeypatch.setattr(queries, "_table", lambda spark, d, name: documents(spark, rows))
    want = Counter()
    for i, t, *_ in rows:
        w = planted(i, t)
        runs = brute_runs(w) if len(w) < 3000 else runs_of([" ".join(w)])[0][1]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest,
              hashlib.sha256(collapse(w, runs).encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in queries.op11_periodic_runs(spark, "").collect())
    assert got == want
    assert sum(n for r, n in got.items() if r[1]) > 5
    assert periodic.periodic_runs(documents(spark, [])).count() == 0
    assert periodic.periodic_runs(documents(spark, odd_rows())).count() == len(odd_rows())


# ---------------------------------------------------------------- operator 12

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAé .,\n\t\r▁<s>/'1ß\x00", max_size=40), st.text(max_size=30)), max_size=6)


def counts(texts, table=()):
    coder = token_counts.counter()
    known, sizes = pa.array(list(table), pa.large_binary()), np.array(coder.lengths(list(table)), np.int64)
    out = []
    for s in slices(pa.array(texts, pa.string())):
        out += token_counts._of_slice(s, coder, known, sizes).tolist()
    return out


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(texts):
    library = token_counts.counter().library
    want = [len(library.encode(t or "")) for t in texts]
    assert counts(texts) == want
    assert counts(texts, [b" a", b" ", b"\n", b"a", b"  "]) == want


def test_counts_of_special_cases():
    texts = ["", " ", "  a  ", "\n", "\n\n a", "a\n", "a \n \n b", "▁", " ▁a▁ b", "<s></s><unk><0x0A>", "a\tb\rc", "x" * 5000, "é" * 3000 + " y", "日本語 テキスト\n日本"]
    library = token_counts.counter().library
    assert counts(texts) == [len(library.encode(t)) for t in texts]


def test_count_query_equals_the_library(spark, monkeypatch):
    library = token_counts.counter().library
    real = [(r["doc_id"], r["text"], "en", "a") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    for rows in (real, odd_rows()):
        monkeypatch.setattr(queries, "_table", lambda spark, d, name: documents(spark, rows))
        got = Counter(tuple(r) for r in queries.op12_token_counts(spark, "").collect())
        n = {t: len(library.encode(t or "")) for _, t, *_ in rows}
        assert got == Counter((i, len((t or "").encode()), n[t], n[t] > 4096) for i, t, *_ in rows)
    assert token_counts.count_tokens(documents(spark, [])).count() == 0


def test_frequent_pre_tokens_cover_all_documents(spark):
    rows = [(i, f"alpha beta{i} gamma\nalpha", "en", "a") for i in range(400)]
    assert token_counts.frequent(documents(spark, rows).repartition(4), 3) == [b"\n", b" alpha", b" gamma"]
    assert len(token_counts.frequent(documents(spark, rows), 10_000)) == 404
    held, n = token_counts._thin(pa.array([b"a", b"b", b"c"], pa.large_binary()), np.array([5, 1, 9]), 2)
    assert dict(zip(held.to_pylist(), n.tolist())) == {b"a": 4, b"c": 8}


def test_cache_starts_again(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 40)
    coder = token_counts.PieceCounter()
    rng = random.Random(1)
    for _ in range(20):
        words = [" " + "".join(rng.choices("abcd", k=3)) for _ in range(30)]
        got = coder.cached([w.encode() for w in words])
        assert got == [len(coder.library.encode(w[1:])) for w in words]
        assert len(coder.cache) <= 40


# ---------------------------------------------------------------- operator 13

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, 7) for i, v in rows], "vec_id long, embedding array<float>, index int, x int, z int")


def check_whitening(rows, got, top=8):
    fine = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.array([np.floor(1024 * np.array(v)).astype(np.int64) + 100000 for _, v in fine])
    n, sums = len(x), x.sum(axis=0)
    cov = np.cov((x - sums / n).T, bias=True).reshape(x.shape[1], -1)
    values, by = np.linalg.eigh(cov)
    values, by = values[::-1], by[:, ::-1]
    top = min(top, x.shape[1])
    assert len(got) == n * top
    of = defaultdict(list)
    for r in got:
        of[r["component"]].append(r)
    assert sorted(of) == list(range(1, top + 1))
    dev = Counter((i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))) for (i, _), row in zip(fine, x))
    for c, part in of.items():
        assert Counter((r["vec_id"], int(r["deviation"])) for r in part) == dev
        assert all(r["n"] == n and abs(r["explained"] - values[c - 1] / np.trace(cov)) < 1e-9 and r["identity_error"] < 1e-6 for r in part)
        want = (x - sums / n) @ by[:, c - 1] / np.sqrt(values[c - 1])
        mine = {r["vec_id"]: r["whitened"] for r in part}
        best = min(max(abs(mine[i] - sign * y) for (i, _), y in zip(fine, want)) for sign in (1, -1))
        assert best < 1e-6


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 64)   # several blocks and tasks
    monkeypatch.setattr(whitening, "MID", 1)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 12)) @ np.diag(np.linspace(3, 0.2, 12)) @ rng.normal(size=(12, 12)) + 5
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(base)]
    odd = [(1000, None), (1001, [float("nan")] * 12), (1002, [None] + [1.0] * 11), (1003, [float("inf")] + [0.0] * 11)]
    got = whitening.whiten(vectors(spark, rows + odd).repartition(5)).collect()
    check_whitening(rows + odd, got)


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, SF_SMALL)
    assert got.schema["deviation"].dataType.simpleString() == "bigint"
    check_whitening(rows, got.collect())


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, []), (3, [float("nan")])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0])])).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["explained"]) for r in sorted(one, key=lambda r: r["component"])] == [
        (c, None, 0, None) for c in (1, 2, 3)]
    same = whitening.whiten(vectors(spark, [(None, [1.0, 0.0]), (2, [1.0, 4.0]), (2, [1.0, 4.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])])).collect()
    flat = [r for r in same if r["component"] == 2]
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] < 1e-9 for r in flat)
    assert sorted(round(abs(r["whitened"]), 6) for r in same if r["component"] == 1) == [0.707107, 0.707107, 1.414214]
