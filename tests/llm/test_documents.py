"""Operators 2, 4, 5, 6 and 10 and the pipeline against brute force."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from hrlens.llm import langid, line_dedup, mixing, packing, queries, repetition
from hrlens.llm.tokens import tokenizer
from tests.llm.odd import documents, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def _quality(text):
    w = WORD.findall(text or "")

    def cover(n, first):
        seen, where = set(), defaultdict(list)
        for i in range(len(w) - n + 1):
            where[tuple(w[i:i + n])].append(i)
        for at in where.values():
            for i in at[0 if first else 1:] if len(at) > 1 else []:
                seen.update(range(i, i + n))
        return seen
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    again = [x in lines[:i] for i, x in enumerate(lines)]
    later = [x for x, known in zip(lines, again) if known]
    fresh = [not known for x, known in zip(lines, again) for _ in WORD.findall(x)]
    chars = sum(map(len, w))
    out = {"n_words": len(w), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(later),
           "n_repeat_words": len(cover(3, True)), "dup_line_chars": sum(len(x) for y in later for x in WORD.findall(y))}
    for n in repetition.NGRAM_LIMITS:
        out[f"dup_{n}gram_chars"] = sum(len(w[i]) for i in cover(n, False))
        out[f"fresh_dup_{n}gram_chars"] = sum(len(w[i]) for i in cover(n, False) if fresh[i])
    out["base_failed"] = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    out["kept"] = not out["base_failed"] and out["n_symbols"] <= 0.1 * len(w) and out["dup_line_chars"] <= 0.2 * chars and all(
        out[f"dup_{n}gram_chars"] <= x * chars for n, x in repetition.NGRAM_LIMITS.items())
    return out


def test_repetition_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in small(spark).collect() if len(r["text"]) < 6000]
    rows += [x for x in odd_rows() if len(x[1] or "") < 1000]
    long = "\n".join(f"line {i} of many says {i * 7919 % 104729} and {i * 31 % 997}" for i in range(4000))
    rows += [(8999, long + "\n" + long[-9000:], "en", "s")]
    # 19 % of the characters in a repeated line and 9 % in other repeated windows: over the limit together
    parts = ["".join(c * 4 for c in x) for x in ("abcdefghij", "klmnopqrst")]
    line, other = (" ".join(x[i:i + 4] + k for i in range(0, 40, 4)) for x, k in zip(parts, "uv"))
    fill = " ".join(f"{i:05d}" for i in range(80))
    rows += [(8998, f"{line}\n{fill}\n{line}\n{other} x {other}", "en", "s")]
    rows += [(9000, "spam and eggs and more of this and that thing " * 30, "en", "s"), (9001, "one line of it all\n" * 40, "en", "s")]
    docs = documents(spark, rows)
    got = repetition.quality(docs).collect()
    want = Counter((i, tuple(sorted(_quality(t).items()))) for i, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(sorted((k, v) for k, v in r.asDict().items() if k != "doc_id"))) for r in got) == want
    both = next(r for r in got if r["doc_id"] == 8998)
    assert both["dup_line_chars"] <= 0.2 * both["word_chars"] and both["fresh_dup_10gram_chars"] <= 0.1 * both["word_chars"] < both["dup_10gram_chars"]
    assert not both["base_failed"] and not both["kept"]
    assert repetition.quality(documents(spark, [])).count() == 0
    assert repetition.quality(documents(spark, odd_rows())).count() == len(odd_rows())


def _check_packing(rows, out, size):
    coder = tokenizer()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(coder.library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, a in enumerate(range(0, len(ids), size)):
            want[i, p, a, len(ids[a:a + size]), zlib.crc32(ids[a:a + size].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for a, n in sorted(held):
            assert a == end
            end += n
        assert end <= size
    return len(bins), -(-sum(r["length"] for r in out) // size)


def test_packing_round_trip(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in small(spark).collect()] + odd_rows()
    docs = documents(spark, rows)
    bins, least = _check_packing(rows, packing.pack(docs).collect(), 4096)
    assert bins <= least + 1
    monkeypatch.setattr(packing, "GROUP", 40)  # several groups and rounds
    packed = packing.pack(docs, size=1024, with_ids=True).cache()
    bins, least = _check_packing(rows, packed.drop("ids").collect(), 1024)
    assert bins <= 1.02 * least + 1
    whole = packing.sequences(packed).collect()
    assert len(whole) == bins and all(len(r["ids"]) <= 1024 for r in whole)
    assert sum(len(r["ids"]) for r in whole) == packed.agg(F.sum("length")).first()[0]
    assert packing.pack(documents(spark, [])).count() == 0


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(3)
    better = 0
    for _ in range(60):
        lengths = rng.integers(20, 60, 40)
        before = packing.best_fit(lengths, 100)
        after = packing.improve(lengths, before, 100)
        assert sorted(i for b in after for i in b) == list(range(40))
        assert all(lengths[b].sum() <= 100 for b in after)
        assert len(after) <= len(before)
        better += len(after) < len(before)
    assert better


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level >= 2 * sizes[s]]
        if not over:
            target.update({s: w[s] * level for s in open_})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in small(spark).collect()] + odd_rows() + [
        (7000 + i, f"x y z {i}", "en", None if i % 3 else "éclair") for i in range(3000)]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_"]
    got = [(r["doc_id"], r["source"], *r["mix_"]) for r in mixed.collect()]
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = _targets(sizes)
    taken = defaultdict(int)
    for i, s, size, source_size, target, copies, words in got:
        assert source_size == sizes[s] and target == pytest.approx(want[s], rel=1e-12)
        assert copies <= 2 and words == copies * size
        taken[s] += words
    for s in (None, "éclair"):
        assert taken[s] == pytest.approx(want[s], rel=0.1)
    assert Counter(map(str, got)) == Counter(str((r["doc_id"], r["source"], *r["mix_"])) for r in mixing.mix(docs.repartition(7)).collect())
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(x[5] for x in got)
    assert mixing.mix(documents(spark, [])).count() == 0


def test_line_dedup(spark):
    common, near = "Share this  page", "Seen on nine sites"
    rows = [(i, f"Own line {i} with words enough to be most of it.\n {common}\t\n\nOther {i}\n{near if i < 9 else ''}", "en", f"s{i}") for i in range(12)]
    rows += [(100 + i, "A copied page\nwith two lines", "en", f"s{i}") for i in range(12)]
    rows += odd_rows()
    docs = documents(spark, rows)
    out = line_dedup.remove_spread_lines(docs, report="seen")
    assert out.columns == [*docs.columns, "seen"]
    got = {(r["doc_id"], r["source"]): (r["text"], r["seen"]["n_removed"]) for r in out.collect()}
    for i, t, _, s in rows:
        if i is not None and i < 12 and s == f"s{i}":
            assert got[i, s] == ("\n".join(x for x in t.split("\n") if x.strip() != common), 1)
        else:
            assert got[i, s] == (t, 0) or i is None
    exact = {r["key"]: r["sites"] for r in line_dedup.spread_lines(docs, 9).collect()}
    assert sorted(exact.values()) == [9, 12, 12, 12]
    assert line_dedup.remove_spread_lines(documents(spark, [])).count() == 0


def test_line_dedup_whatever_the_share(spark):
    common = ["Share this page with all of your friends", "All rights reserved by the owner"]
    both = "\n".join(common)
    rows = [(i, f"{both}\nOwn {i}", "en", f"s{i}") for i in range(12)]          # mostly boilerplate, each text once
    rows += [(50, both, "en", "s0"), (51, f"{both}\nOn two", "en", "s1"), (52, f"{both}\nOn two", "en", "s2")]
    rows += [(100 + i, f"A copied page\nwith three lines\n{common[0]}", "en", f"s{i}") for i in range(12)]
    got = {r["doc_id"]: (r["text"], r["seen"]["n_removed"])
           for r in line_dedup.remove_spread_lines(documents(spark, rows), report="seen").collect()}
    want = {i: (f"Own {i}", 2) for i in range(12)} | {50: ("", 2), 51: ("On two", 2), 52: ("On two", 2)}
    assert got == want | {100 + i: ("A copied page\nwith three lines", 1) for i in range(12)}


def test_language_model_is_normalised(spark):
    docs = documents(spark, [(i, "abba baab abab " * 3, "x", "s") for i in range(5)] + [(9, "cdc dcd", "y", "s")])
    model = langid.fit(docs)
    assert model.langs == ["x", "y"]
    ctx = np.array([ord("a") << 32 | ord("b") << 16 | ord("b")], np.uint64)
    codes = (ctx << np.uint64(16)) | np.arange(65536, dtype=np.uint64)
    assert np.exp(-model.surprise(codes).astype(float)).sum(1) == pytest.approx([1, 1], abs=1e-3)


def test_language_model_keeps_every_gram(spark, monkeypatch):
    """A corpus over the size of the broadcast has the same model and the same results."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in small(spark).collect() if len(r["text"]) < 6000]
    docs = documents(spark, rows + [(10_000 + k, *x[1:]) for k, x in enumerate(odd_rows())])
    train = docs.filter("text is not null and lang is not null")
    want = {x: set() for x in langid.fit(docs).langs}
    for r in train.collect():
        want[r["lang"]] |= set(langid.symbols([r["text"]])[1].tolist())

    def results():
        model = langid.tables(docs)
        kept = {x: set() for x in model.langs}
        for r in model.grams[0].collect():
            kept[r["lang"]].add(r["k"] % 2 ** 64)
        assert kept == want
        found = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["rejected"], r["score"], r["cross_entropy"] or -1.0)
                        for r in langid.identify(docs).collect()), key=str)
        return found, sorted(map(str, langid.drop_rejected(docs).collect()))

    whole, stay = results()
    monkeypatch.setattr(langid, "MODEL_ENTRIES", 100)
    monkeypatch.setattr(langid, "SLICE_BYTES", 50_000)
    joined, stay_too = results()
    assert [x[:4] for x in joined] == [x[:4] for x in whole] and stay_too == stay
    assert [y for x in joined for y in x[4:]] == pytest.approx([y for x in whole for y in x[4:]], abs=1e-4)


def test_language_identification(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    odd = [(100_000 + k, *x[1:]) for k, x in enumerate(odd_rows())]
    odd += [(200_000, "qx zvk jqwz xkcd pfft qqq zzzkw vvxq jjjx wqz kzx " * 20, None, "s")]
    docs = documents(spark, rows + odd)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    lang = {i: x for i, _, x, _ in rows}
    for i in lang:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in lang if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.98
    assert np.mean([got[i]["rejected"] for i in lang]) < 0.005
    for i, t, *_ in odd:
        und = not any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == und and 0 <= got[i]["score"] <= 1
        assert got[i]["rejected"] or not und
    assert got[200_000]["rejected"]
    kept = langid.drop_rejected(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i in got if not got[i]["rejected"])
    assert langid.identify(documents(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(documents(spark, [(1, "abc", None, "s")])).collect()} == {"und"}


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in small(spark).collect()] + [
        (10_000 + k, *x[1:]) for k, x in enumerate(odd_rows()) if x[0] != 5]
    for given in (rows, []):
        docs = documents(spark, given)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF_SMALL)
            if k < 4:
                assert docs.columns == columns
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (docs.count() > 0) == bool(given)


def test_pipeline_decisions_take_effect(spark):
    docs = small(spark)
    out = corpus_pipeline.language(spark, docs, SF_SMALL)
    out = corpus_pipeline.lines(spark, out, SF_SMALL)
    assert out.filter(F.char_length("text") != F.col("n_chars")).count() == docs.filter(F.char_length("text") != F.col("n_chars")).count()
    one = corpus_pipeline.near_duplicates(spark, out, SF_SMALL)
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) < docs.count()


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
