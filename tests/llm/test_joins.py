"""Operators 1 and 7 and the components below them against brute force."""
import math
import random
import re

import numpy as np
import pytest

from hrlens.llm import ego_join, ngram_join
from hrlens.llm.store import components
from tests.llm.odd import documents, odd_rows


def _classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 301 + 200 + 50
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(25):
            base = rng.normal(size=12)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, (base + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.15])).tolist(), label))
                i += 1
    rows += [(i, rows[0][1], 1), (i + 1, rows[0][1], 2), (i + 2, [0.0] * 12, 1), (i + 3, None, 1), (i + 4, [1.0, None] + [0.0] * 10, 1),
             (i + 5, [float("nan")] * 12, 1), (i + 6, rows[1][1], None), (i + 7, [float("inf")] + [1.0] * 11, 2), (i + 8, [], 1),
             (i + 9, rows[3][1][:5], 1), (None, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("interval", [3, 2048])
def test_grid_join_equals_brute_force(spark, monkeypatch, interval):
    monkeypatch.setattr(ego_join, "INTERVAL", interval)
    monkeypatch.setattr(ego_join, "LEAF", 2)
    rows = _vectors(interval)

    def unit(v):
        if not v or None in v or not all(map(math.isfinite, v)) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)
    units = [unit(v) for _, v, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] is not None and rows[a][2] == rows[b][2]
             and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98]
    cls = _classes(len(rows), links)
    least = {}
    for (i, _, _), c in zip(rows, cls):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = sorted(((i, int(n[k]), least.get(cls[k])) for k, (i, _, _) in enumerate(rows)), key=str)
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, label int, uid double")
    got = ego_join.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_grid_join_of_nothing(spark):
    assert ego_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _sets(texts, k):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        out.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def _jaccard_want(rows, k, num, den):
    sets = _sets([t for _, t, *_ in rows], k)
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    cls = _classes(len(rows), links)
    least = {}
    for (i, *_), c in zip(rows, cls):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((r[0], len(s), least.get(c)) for r, s, c in zip(rows, sets, cls)), key=str)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5), (1, 4, 5)])
def test_jaccard_join_equals_brute_force(spark, k, num, den):
    rng = random.Random(k * 100 + num)
    texts = []
    for size in [6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 70, 120, 300]:
        for _ in range(3):
            base = [f"W{rng.randrange(10 ** 6)}" for _ in range(size)]
            for _ in range(5):
                t = list(base)
                for _ in range(rng.randrange(0, 1 + size // (6 * k) + 1)):
                    if rng.random() < 0.5 and len(t) > 1:
                        t.pop(rng.choice([0, len(t) - 1]))
                    else:
                        t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
                texts.append((" " if rng.random() < 0.9 else "\n").join(t))
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(i, t) for i, t, *_ in odd_rows()]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = ngram_join.jaccard_components(docs, k, num, den).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _jaccard_want(rows, k, num, den)


@pytest.mark.parametrize("held", [1 << 16, 12])
def test_jaccard_join_of_a_drifting_group_in_blocks(spark, monkeypatch, held):
    """A chain of copies whose ends are far apart, with groups longer than a block, also longer than a task keeps."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HELD", held)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words)))
        words[rng.randrange(60)] = f"n{i}"
    rng.shuffle(rows)
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = ngram_join.jaccard_components(docs, 2, 4, 5).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _jaccard_want(rows, 2, 4, 5)


@pytest.mark.parametrize("held", [1 << 16, 50])
def test_frequent_signatures_are_spread_over_tasks(spark, held):
    """Blocks of at most eight holders that together hold each group once, whole or cut by tasks."""
    rng = random.Random(held)
    sigs = [(7, u) for u in range(400)] + [(s, rng.randrange(10 ** 6)) for s in range(8, 60) for _ in range(s % 5)] + [(-3, 5), (99, 5)]
    df = spark.createDataFrame(sigs + sigs[:30], "sig long, uid long")
    got = (df.repartitionByRange(4, "sig", "uid").sortWithinPartitions("sig", "uid")
           .mapInArrow(ngram_join._groups(8, held), "grp long, blk long, size long, cut boolean, uid long").collect())
    groups, blocks = {}, {}
    for r in got:
        groups.setdefault(r["grp"], []).append(r["uid"])
        blocks.setdefault((r["grp"], r["blk"]), []).append(r["uid"])
    assert max(map(len, blocks.values())) <= 8
    assert len({r["blk"] >> ngram_join.TASK_BITS for r in got if r["grp"] == 7}) > 1
    want = {}
    for s, u in sigs:
        want.setdefault(s, set()).add(u)
    assert sorted(groups[7]) == sorted(want[7])
    many = {tuple(sorted(v)) for v in want.values() if len(v) > 1}
    assert many <= {tuple(sorted(v)) for v in groups.values()}
    # a group that is not cut holds two or more; cut ones keep the signature as their name
    assert all(len(v) > 1 for g, v in groups.items() if g not in want)


def test_layouts_satisfy_the_pigeonhole():
    used = 0
    for num, den in ((85, 100), (4, 5), (1, 2), (9, 10)):
        for band in range(20):
            m, d, h = ngram_join.layout(band, num, den)
            top = ngram_join.band_edges(num, den)[band + 1] - 1
            assert m >= d and m + d > h >= ngram_join.max_difference(top, top, num, den)
            used += d
    assert used  # one-deletion neighbourhoods are allocated where they pay


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, "en", "a"), (3, text + " end", "en", "b"), (3, text + " end", "en", "b"), (9, "quite another text of six words", "en", "a"),
            (None, text, "en", "a"), (None, "lonely words without any id", "en", "a"), (None, "lonely words without any id", "en", "a"), (2, None, "en", "a")]
    out = ngram_join.keep_one(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        [(3, text + " end"), (9, "quite another text of six words"), (None, "lonely words without any id"), (2, None)], key=str)
    assert ngram_join.keep_one(documents(spark, [])).count() == 0


def test_keep_one_judges_every_text_of_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    c, d = (" ".join(f"{c}{i}" for i in range(40)) for c in "cd")
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (3, c, "en", "s"), (3, d, "en", "s"), (3, d, "en", "s"),
            (4, d + " end", "en", "s"), (5, "", "en", "s"), (5, None, "en", "s"), (5, "", "en", "s")]
    got = ngram_join.keep_one(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(
        [(1, a), (2, b), (3, c), (3, d), (5, ""), (5, None)], key=str)


def test_keep_one_of_one_id_with_two_similar_texts(spark):
    a = " ".join(f"w{i}" for i in range(90))
    got = ngram_join.keep_one(documents(spark, [(7, a, "en", "s"), (7, a + " end", "en", "s"), (8, a, "en", "t")])).collect()
    assert len(got) == 1 and got[0]["doc_id"] == 7
