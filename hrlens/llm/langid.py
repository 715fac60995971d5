"""Operator 10: language identification with interpolated Kneser-Ney character models.

Training counts the character 4-grams of every labelled training text (letters lower-cased, every
run of other characters one boundary symbol).  Kneser-Ney needs nothing else: lower orders use
continuation counts, the number of distinct characters seen before a gram.  Counts are pre-reduced
in each task and summed by Spark.

The model is a table of discounted probabilities by language and gram, and one of interpolation
weights by language and context; every gram seen in training stays.  While an order has at most
``MODEL_ENTRIES`` grams over all languages the tables are broadcast as sorted arrays of hashes.  A
larger model stays in its tables: the distinct grams of the distinct texts, per slice of about
``SLICE_BYTES``, are joined with it order by order (a gram with its suffix's cost, so no key has more
rows than there are symbols), and each slice is scored beside the costs of its own grams.

A text gets the language with the lowest cross-entropy per symbol.  Rejection is calibrated on
the training texts by language and length class: a text whose cross-entropy lies far outside of
what its language's own texts of that length have is rejected, as is one without letters.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; rows
with a null language are predicted but not learned from; ties go to the first language by code
point; without any learnable language all rows are ``und``; repeated rows are scored alike and an
empty table gives no rows.  Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hrlens.llm.store import free_name, staged
from hrlens.llm.textkit import U, drop_caches, give_back, gives_back, mix

ORDER = 4
MODEL_ENTRIES = 1 << 20
UNSEEN = 1.0 / 65536      # uniform share of a symbol below the unigrams
SLICE_BYTES = 4_000_000   # bytes of distinct texts that are scored together when the model is joined
RUN_CHARS = 1_000_000     # characters that a task handles together
KNOWN_GRAMS = 500_000     # grams whose costs a task keeps
FLUSH_GRAMS = 1_000_000   # distinct grams a counting task holds before it hands them on
TEMPERATURES = [2.0 ** i for i in range(0, 8)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 4-gram code) of every predicted symbol and which texts have a letter."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in low])
    cps = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), size)
    letter = _is_letter()[cps]
    keep = letter.copy()
    keep[1:] |= letter[:-1]            # the first symbol after a letter stands for the boundary
    has = np.bincount(doc[letter], minlength=len(low)) > 0
    doc, sym = doc[keep], np.where(letter, (cps ^ (cps >> 16)) & 0xFFFF, 0)[keep].astype(U)
    n = np.bincount(doc, minlength=len(low))
    at = np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)
    code = sym.copy()
    for back in range(1, ORDER):
        prev = np.zeros(len(sym), U)
        prev[back:] = sym[:-back]
        prev[at < back] = 0
        code |= prev << U(16 * back)
    return doc, code, has


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about ``RUN_CHARS`` bytes (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + RUN_CHARS, side="right")))
        yield i, texts[i:j].to_pylist()
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate([c for c, _ in parts])
        n = np.concatenate([x for _, x in parts])
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        return code[first], np.add.reduceat(n, first)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            code, n = merged(parts)
            for i in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code[i:i + 100_000])), pa.array(code[i:i + 100_000].view(np.int64)),
                     pa.array(n[i:i + 100_000])], names=["lang", "code", "n"])

    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), dtype=object)
        for i, texts in _runs(batch["text"]):
            doc, code, _ = symbols(texts)
            own = langs[i:i + len(texts)]
            for lang in sorted(set(own)):
                c, n = np.unique(code[(own == lang)[doc]], return_counts=True)
                if len(c):
                    parts = held.setdefault(lang, [])
                    parts.append((c, n))
                    size += len(c)
                    if len(parts) == 16:
                        size -= sum(len(x) for x, _ in parts)
                        held[lang] = [merged(parts)]
                        size += len(held[lang][0][0])
        if size > FLUSH_GRAMS:
            yield from rows()
            held, size = {}, 0
    yield from rows()


@dataclass
class Model:
    """Sorted hash arrays per language: gram -> probability, context -> interpolation weight."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def surprise(self, codes: np.ndarray) -> np.ndarray:
        """-log p of each code's last symbol: one row per language."""
        out = np.empty((len(self.langs), len(codes)), np.float32)
        for row, (grams, contexts) in enumerate(zip(self.grams, self.contexts)):
            p = np.full(len(codes), UNSEEN)
            for order in range(1, ORDER + 1):
                g = codes & U((1 << (16 * order)) - 1)
                p = _look(grams, _key(g, order), 0.0) + _look(contexts, _key(g >> U(16), order), 1.0) * p
            out[row] = -np.log(np.maximum(p, 1e-12))
        return out


class Scorer:
    """A model with the costs of the grams it has met, bounded by ``KNOWN_GRAMS``."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.langs = model.langs
        self._clear()

    def _clear(self) -> None:
        self.known, self.cost = np.zeros(0, U), np.zeros((len(self.langs), 0), np.float32)

    def surprise(self, codes: np.ndarray) -> np.ndarray:
        """As ``Model.surprise`` for sorted distinct codes."""
        at = np.searchsorted(self.known, codes)
        have = at < len(self.known)
        have[have] = self.known[at[have]] == codes[have]
        if have.all():
            return self.cost[:, at]
        new = codes[~have]
        fresh = self.model.surprise(new)
        out = np.empty((len(self.langs), len(codes)), np.float32)
        out[:, have], out[:, ~have] = self.cost[:, at[have]], fresh
        if len(self.known) + len(new) > KNOWN_GRAMS:
            self._clear()
            self.known, self.cost = codes[:KNOWN_GRAMS], out[:, :KNOWN_GRAMS].copy()
        else:
            place = np.searchsorted(self.known, new)
            self.known, self.cost = np.insert(self.known, place, new), np.insert(self.cost, place, fresh, axis=1)
        return out


def _key(code: np.ndarray, order: int) -> np.ndarray:
    return mix(code * U(2 * ORDER + 1) + mix(np.full(1, order, U)))


def _look(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, default: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(key), default)
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[i] == key, values[i], default)


@dataclass
class Tables:
    """The written model: per order from ``ORDER`` down ``(lang, k, v)`` of grams and of contexts."""

    langs: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    size: int             # grams of the longest order, which has the most


def tables(train: DataFrame) -> Tables:
    """The model of ``train(text, lang)``; every row with both is counted whole."""
    counts = staged(train.filter("text is not null and lang is not null").select("text", "lang")
                    .mapInArrow(gives_back(_count), "lang string, code long, n long")
                    .groupBy("lang", "code").agg(F.sum("n").alias("c")), "lang-grams")
    found = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    gram_rows, ctx_rows = [], []
    table = counts
    for order in range(ORDER, 0, -1):
        totals = (table.groupBy("lang").agg(
            F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
            .select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d")))
        ctx = F.shiftrightunsigned("code", 16)
        ctx_totals = table.groupBy("lang", ctx.alias("ctx")).agg(F.sum("c").alias("tot"))
        grams = (table.join(F.broadcast(totals), "lang")  # one row per language
                 .withColumn("ctx", ctx).join(ctx_totals, ["lang", "ctx"])
                 .select("lang", "code", "ctx", ((F.col("c") - F.col("d")) / F.col("tot")).alias("p")))
        grams = staged(grams, f"lang-order{order}")
        gram_rows.append(grams.select("lang", F.col("code").alias("k"), F.col("p").alias("v")))
        ctx_rows.append(grams.groupBy("lang", F.col("ctx").alias("k")).agg((1 - F.sum("p")).alias("v")))
        if order > 1:
            mask = (1 << (16 * (order - 1))) - 1
            table = staged(table.groupBy("lang", F.col("code").bitwiseAND(F.lit(mask)).alias("code"))
                           .agg(F.count("*").alias("c")), f"lang-cont{order - 1}")
    return Tables(sorted(found), gram_rows, ctx_rows, sum(found.values()))


def fit(train: DataFrame) -> Model:
    """The whole model of ``train(text, lang)`` as arrays."""
    return _arrays(tables(train))


def _arrays(model: Tables) -> Model:
    def arrays(parts: list[DataFrame]) -> list[tuple[np.ndarray, np.ndarray]]:
        by = {lang: ([], []) for lang in model.langs}
        for order, part in zip(range(ORDER, 0, -1), parts):
            got = part.toArrow()
            lang = np.array(got["lang"].to_pylist(), dtype=object)
            key = got["k"].to_numpy().view(U)
            value = np.clip(got["v"].to_numpy(), 0.0, 1.0)
            for name in model.langs:
                mine = lang == name
                by[name][0].append(_key(key[mine], order))
                by[name][1].append(value[mine])
        out = []
        for name in model.langs:
            k = np.concatenate(by[name][0] or [np.zeros(0, U)])
            v = np.concatenate(by[name][1] or [np.zeros(0)]).astype(np.float32)
            at = np.argsort(k)
            out.append((k[at], v[at]))
        return out

    return Model(model.langs, arrays(model.grams), arrays(model.contexts))


@dataclass
class Costs:
    """The costs of a slice's grams, sorted by code: one row per language."""

    langs: list[str]
    known: np.ndarray
    cost: np.ndarray

    def surprise(self, codes: np.ndarray) -> np.ndarray:
        return self.cost[:, np.searchsorted(self.known, codes)]


def _slice_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slices = batch["slice"].to_numpy()
        for i, texts in _runs(batch["text"]):
            doc, code, _ = symbols(texts)
            own = slices[i:i + len(texts)][doc]
            for one in np.unique(own):
                c = np.unique(code[own == one])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), one)), pa.array(c.view(np.int64))], names=["slice", "code"])


def _gram_costs(codes: DataFrame, model: Tables) -> DataFrame:
    """``code, cost`` of distinct 4-gram codes: -log p by language, as ``Model.surprise``."""
    wanted = [codes]
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (16 * order)) - 1)
        wanted.append(staged(wanted[-1].select(F.col("code").bitwiseAND(mask).alias("code")).distinct(), f"lang-want{order}"))

    def by_language(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), "v"))))).alias(name))

    below = None
    langs = F.array(*[F.lit(x) for x in model.langs])
    for order in range(1, ORDER + 1):
        rows = wanted[ORDER - order].withColumn("ctx", F.shiftrightunsigned("code", 16))
        grams, contexts = by_language(model.grams[ORDER - order], "g"), by_language(model.contexts[ORDER - order], "w")
        if order == 1:
            contexts = F.broadcast(contexts)  # a single row
            rows = rows.withColumn("low", F.array_repeat(F.lit(UNSEEN), len(model.langs)))
        else:
            rows = (rows.withColumn("rest", F.col("code").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1)))
                    .join(below, "rest"))
        p = F.zip_with(langs, "low", lambda lang, low: F.coalesce(F.element_at("g", lang), F.lit(0.0))
                       + F.coalesce(F.element_at("w", lang), F.lit(1.0)) * low)
        rows = (rows.join(grams.withColumnRenamed("k", "code"), "code", "left")
                .join(contexts.withColumnRenamed("k", "ctx"), "ctx", "left").select("code", p.alias("p")))
        below = staged(rows, f"lang-costs{order}").select(F.col("code").alias("rest"), F.col("p").alias("low"))
    return below.select(F.col("rest").alias("code"), F.transform("low", lambda x: -F.log(F.greatest(x, F.lit(1e-12)))).cast("array<float>").alias("cost"))


_TEXT_COLS = "tkey string, best string, ce double, gaps array<float>, n long, usable boolean"


def _score_slice(langs: list[str]):
    def run(texts: pa.Table, grams: pa.Table) -> pa.Table:
        code = grams["code"].to_numpy().view(U)
        cost = grams["cost"].combine_chunks().flatten().to_numpy().reshape(len(code), len(langs)).T if len(code) else np.zeros((len(langs), 0), np.float32)
        at = np.argsort(code)
        costs = Costs(langs, code[at], cost[:, at])
        out = [pa.RecordBatch.from_arrays([batch["tkey"][i:i + len(part)], *_scores(costs, part)[0]],
                                          names=["tkey", "best", "ce", "gaps", "n", "usable"])
               for batch in texts.to_batches() for i, part in _runs(batch["text"])]
        return pa.Table.from_batches(out, pa.schema([("tkey", pa.string()), ("best", pa.string()), ("ce", pa.float64()), (
            "gaps", pa.list_(pa.float32())), ("n", pa.int64()), ("usable", pa.bool_())]))
    return run


def _score_by_join(rows: DataFrame, model: Tables) -> DataFrame:
    """``rows`` scored as by ``_score``, against the model in its tables."""
    texts = rows.filter("text is not null").select(F.md5("text").alias("tkey"), "text").groupBy("tkey").agg(F.first("text").alias("text"))
    texts = staged(texts, "lang-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.withColumn("slice", F.pmod(F.xxhash64("tkey"), F.lit(size // SLICE_BYTES + 1)))
    grams = staged(texts.select("slice", "text").mapInArrow(gives_back(_slice_grams), "slice long, code long").distinct(), "lang-slices")
    costs = _gram_costs(staged(grams.select("code").distinct(), "lang-want"), model)
    scored = (texts.groupBy("slice").cogroup(grams.join(costs, "code").groupBy("slice"))
              .applyInArrow(_score_slice(model.langs), _TEXT_COLS))
    where = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("lang"))
    return (rows.withColumn("tkey", F.md5("text")).join(staged(scored, "lang-text-scores"), "tkey", "left")
            .select("doc_id", F.col("lang").alias("text_lang"), "crc", F.coalesce("best", F.lit("und")).alias("best"),
                    F.coalesce("ce", F.lit(0.0)).alias("ce"),
                    (F.col("ce") + F.when(where > 0, F.get("gaps", (where - 1).cast("int"))).cast("double")).alias("own"),
                    "gaps", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("usable", F.lit(False)).alias("usable"), "tkey"))


def cross_entropy(model: Model | Scorer | Costs, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nats per symbol, one row per language; number of symbols; has a letter)."""
    doc, code, has = symbols(texts)
    uniq, back = np.unique(code, return_inverse=True)
    cost = model.surprise(uniq)
    n = np.bincount(doc, minlength=len(texts))
    total = np.stack([np.bincount(doc, cost[i][back], minlength=len(texts)) for i in range(len(model.langs))]) \
        if model.langs else np.zeros((0, len(texts)))
    return total / np.maximum(n, 1), n, has & (len(model.langs) > 0)


_COLS = "doc_id long, text_lang string, crc long, best string, ce double, own double, gaps array<float>, n long, usable boolean"


def _scores(model: Scorer | Costs, texts: list[str | None]) -> tuple[list[pa.Array], np.ndarray]:
    """(``best, ce, gaps, n, usable`` of the texts; nats per symbol, one row per language)."""
    ce, n, has = cross_entropy(model, texts)
    names = np.array([*model.langs, "und"], dtype=object)
    best = np.where(has, ce.argmin(0) if len(ce) else 0, len(model.langs))
    lowest = ce.min(0) if len(ce) else np.zeros(len(texts))
    gaps = (ce - lowest).T.astype(np.float32)
    off = np.arange(len(texts) + 1, dtype=np.int32) * len(model.langs)
    return [pa.array(names[best], pa.string()), pa.array(lowest), pa.ListArray.from_arrays(pa.array(off), pa.array(gaps.ravel())),
            pa.array(n.astype(np.int64)), pa.array(has)], ce


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Scorer(shared.value)
        where = {x: i for i, x in enumerate(model.langs)}
        for batch in batches:
            for i, texts in _runs(batch["text"]):
                (best, lowest, gaps, n, has), ce = _scores(model, texts)
                rows = slice(i, i + len(texts))
                labels = batch["lang"][rows].to_pylist()
                own = [float(ce[where[x], j]) if x in where else None for j, x in enumerate(labels)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][rows], batch["lang"][rows], batch["crc"][rows], best, lowest, pa.array(own, pa.float64()),
                     gaps, n, has],
                    names=["doc_id", "text_lang", "crc", "best", "ce", "own", "gaps", "n", "usable"])
    return run


def length_class(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def _adds(heat: float):
    return lambda total, gap: total + F.exp(-heat * gap)


def _calibrate(scored: DataFrame) -> tuple[float, dict[tuple[str, int], float]]:
    """(temperature of the score, largest accepted cross-entropy by language and length class),
    from the training rows; both are a few numbers per language."""
    usable = scored.filter("usable and own is not null")
    sums = usable.agg(*[F.sum(-t * (F.col("own") - F.col("ce")) - F.log(F.aggregate(
        "gaps", F.lit(0.0), _adds(t)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    gain = [x if x is not None else 0.0 for x in sums]
    limits = (usable.filter("best = text_lang").groupBy("best", length_class(F.col("n")).alias("b"))
              .agg(F.percentile_approx("ce", [0.5, 0.95], 1000).alias("q"), F.count("*").alias("m")))
    accepted: dict[tuple[str, int], float] = {}
    for r in limits.collect():  # languages x length classes
        accepted[r["best"], r["b"]] = (r["q"][0] + REJECT_SPREAD * (r["q"][1] - r["q"][0])
                                       + REJECT_MARGIN + SHORT_MARGIN / 2 ** (r["b"] / 2))
    return TEMPERATURES[int(np.argmax(gain))], accepted


REJECT_SPREAD = 4.0   # times the distance from the median to the 95th percentile
REJECT_MARGIN = 1.0   # nats per symbol
SHORT_MARGIN = 4.0    # the same over the square root of the length


def _limit(accepted: dict[tuple[str, int], float], lang: str, size: int) -> float:
    """The limit of the nearest calibrated length class of the language."""
    own = {b: x for (name, b), x in accepted.items() if name == lang}
    if not own:
        return float("inf")
    near = min(own, key=lambda b: (abs(b - size), b))
    return own[near] + 0.25 * max(0, near - size)  # shorter than any calibrated: more tolerance


def _limit_map(model: Tables, accepted) -> Column:
    pairs = [x for lang in model.langs for size in range(0, 40)
             for x in (F.lit(f"{lang}\t{size}"), F.lit(_limit(accepted, lang, size)))]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(0.0))


def _prepare(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"),
                       F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("crc"))


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score, cross_entropy, rejected``.

    Rows whose ``crc32(id) % folds`` is ``held_fold`` are predicted only.
    """
    rows = _prepare(docs, id_col, text_col, lang_col)
    model = tables(rows.filter(F.col("crc") % folds != held_fold))
    if model.size <= MODEL_ENTRIES:
        shared = docs.sparkSession.sparkContext.broadcast(_arrays(model))
        scored = staged(rows.mapInArrow(gives_back(_score(shared)), _COLS), "lang-scored")
    else:
        scored = staged(_score_by_join(rows, model), "lang-scored")
    heat, accepted = _calibrate(scored.filter(F.col("crc") % folds != held_fold))
    spread = F.aggregate("gaps", F.lit(0.0), _adds(heat))
    limit = F.element_at(_limit_map(model, accepted), F.concat("best", F.lit("\t"), length_class(F.col("n")).cast("string")))
    return scored.select(
        "doc_id", (F.col("crc") % folds == held_fold).alias("held_out"), F.col("best").alias("lang_pred"),
        F.when(F.col("usable"), F.least(F.lit(1.0), 1.0 / spread)).otherwise(0.0).alias("score"),
        F.when(F.col("usable"), F.col("ce")).alias("cross_entropy"),
        (~F.col("usable") | (F.col("ce") > limit)).alias("rejected"))


def drop_rejected(docs: DataFrame, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that language identification rejects, all columns as they were."""
    rows = _prepare(docs, id_col, text_col, lang_col)
    model = tables(rows.filter(F.col("crc") % folds != held_fold))
    if model.size > MODEL_ENTRIES:
        scored = staged(_score_by_join(rows, model), "lang-scored")
        _, accepted = _calibrate(scored.filter(F.col("crc") % folds != held_fold))
        limit = F.element_at(_limit_map(model, accepted), F.concat("best", F.lit("\t"), length_class(F.col("n")).cast("string")))
        fine = scored.filter(F.col("usable") & (F.col("ce") <= limit)).select("tkey").distinct()
        name = free_name(docs, "tkey")
        return docs.withColumn(name, F.md5(F.col(text_col).cast("string"))).join(
            fine.withColumnRenamed("tkey", name), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(_arrays(model))
    train = rows.filter((F.col("crc") % folds != held_fold) & F.col("lang").isNotNull())
    _, accepted = _calibrate(staged(train.mapInArrow(gives_back(_score(shared)), _COLS), "lang-calibration"))
    limits = {lang: np.array([_limit(accepted, lang, size) for size in range(64)]) for lang in model.langs}

    @arrow_udf("boolean")
    def accepts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_caches()
        scorer = Scorer(shared.value)
        table = np.stack([limits[x] for x in scorer.langs]) if limits else np.zeros((1, 64))
        for texts in batches:
            out = []
            for _, part in _runs(texts):
                ce, n, has = cross_entropy(scorer, part)
                size = np.floor(np.log2(np.maximum(n, 1))).astype(int)
                best = ce.argmin(0) if len(ce) else np.zeros(len(part), int)
                low = ce.min(0) if len(ce) else np.zeros(len(part))
                out.append(has & (low <= table[best, size]))
            yield pa.array(np.concatenate(out) if out else np.zeros(0, bool))
        give_back()

    return docs.filter(accepts(F.col(text_col).cast("string")))
