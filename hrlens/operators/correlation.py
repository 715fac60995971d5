"""Pearson correlations (A9), redundant pairs (A10) and the greedy redundancy
resolution (L10).

Two aggregate passes, whatever the number of pairs: pass 1 gets each
column's mean, non-null count and range; pass 2 adds up centred cross products.
Every task turns its rows into matrices, values and presence, whose products
hold the sums of all pairs over rows where both are present (pandas'
pairwise-complete rule), and hands over one row per pair; these are summed per
pair.  The cost of a row is a few microseconds (hundreds of aggregate
expressions took some hundred, besides half a minute of planning), and centring
on the mean keeps the sums stable.  A constant column gives null (pandas gives
NaN; Spark's ``corr`` would raise under ANSI).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, label01, lit_d
from ..session import library_on_workers, written


def _present(c: str) -> Column:
    """The value as a double; NaN counts as missing, as in pandas."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict]:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        x = _present(c)
        aggs += [F.avg(x).alias(f"m{i}"), F.count(x).alias(f"n{i}"),
                 (F.min(x) == F.max(x)).alias(f"k{i}")]
    row = df.agg(*aggs).first()
    return row["_n"], {c: (row[f"m{i}"], row[f"n{i}"], bool(row[f"k{i}"]))
                       for i, c in enumerate(columns)}


def _pearson(n: str, sa: str, sb: str, saa: str, sbb: str, sab: str) -> str:
    cov = f"({sab} / {n} - ({sa} / {n}) * ({sb} / {n}))"
    va = f"({saa} / {n} - ({sa} / {n}) * ({sa} / {n}))"
    vb = f"({sbb} / {n} - ({sb} / {n}) * ({sb} / {n}))"
    return f"CASE WHEN {n} > 0 THEN CASE WHEN {va} > 0 AND {vb} > 0 THEN {cov} / sqrt({va} * {vb}) END END"


_SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]


def _products(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """4 x columns x columns, over rows where both columns have a value: their number, the sums of the first
    column, of its squares and of the products.  ``x`` holds 0 where ``there`` is false."""
    with np.errstate(all="ignore"):
        squares = x * x
        if np.isfinite(squares.sum()):
            m = there.astype(float)
            return np.stack((m.T @ m, x.T @ m, squares.T @ m, x.T @ x))
        # 0 times infinity is not 0: absent values are left out one column at a time
        out = np.empty((4, x.shape[1], x.shape[1]))
        for j in range(x.shape[1]):
            both = there & there[:, j:j + 1]
            out[:, :, j] = [both.sum(0), *(np.where(both, v, 0.0).sum(0) for v in (x, squares, x * x[:, j:j + 1]))]
        return out


def _pair_sums(left: list[int], right: list[int]):
    """One row per task and pair (positions of its columns in ``left`` and ``right``): ``_SUMS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            part = _products(x, np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            total = part if total is None else total + part
        if total is not None:
            n, s, ss, p = total
            sums = (n[left, right], s[left, right], s[right, left], ss[left, right], ss[right, left], p[left, right])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left), dtype=np.int32)), *map(pa.array, sums)], names=["k", *_SUMS])
    return run


def _pair_table(df: DataFrame, pairs: list[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """``k, r`` for every requested pair, ``k`` its place in ``pairs``."""
    spark = df.sparkSession
    library_on_workers(spark)
    _, mom = _moments(df, columns)
    pos = {c: i for i, c in enumerate(columns)}
    centred = df.select(*[(_present(c) - lit_d(mom[c][0] if mom[c][0] is not None else 0.0)).alias(f"d{pos[c]}") for c in columns])
    parts = centred.mapInArrow(_pair_sums([pos[a] for a, _ in pairs], [pos[b] for _, b in pairs]),
                               "k int, " + ", ".join(f"{c} double" for c in _SUMS))
    found = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in _SUMS]).selectExpr("k", f"{_pearson(*_SUMS)} AS r")
    # a column that is constant or empty has no r
    live = [all(mom[c][0] is not None and not mom[c][2] for c in p) for p in pairs]
    asked = spark.createDataFrame(list(enumerate(live)), "k int, live boolean")
    return asked.join(F.broadcast(found), "k", "left").select("k", F.when(F.col("live"), F.col("r")).alias("r"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A9 long form: (a, b, ia, ib, r) for every unordered pair a < b in list order."""
    idx = list(combinations(range(len(columns)), 2))
    found = _pair_table(df, [(columns[i], columns[j]) for i, j in idx], columns)
    names = df.sparkSession.createDataFrame([(k, columns[i], columns[j], i, j) for k, (i, j) in enumerate(idx)],
                                            "k int, a string, b string, ia int, ib int")
    return names.join(found, "k").select("a", "b", "ia", "ib", "r")


def correlation_with_label(df: DataFrame, columns: Sequence[str], target: str = "Attrition",
                           positive: str = "Yes", top: int | None = 12) -> DataFrame:
    """R of each numeric column with the 0/1 label, ordered by |r| desc (top-k)."""
    lab = df.select(*[col(c) for c in columns], label01(target, positive).alias("_label"))
    found = _pair_table(lab, [(c, "_label") for c in columns], [*columns, "_label"])
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, feature string")
    out = names.join(found, "k").select("feature", "r").orderBy(F.desc_nulls_last(F.abs("r")), "feature")
    return out.limit(top) if top else out


def redundant_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.92) -> DataFrame:
    """A10: upper-triangle pairs with |r| ≥ threshold (tested unrounded), |r| rounded to 4."""
    p = correlation_pairs(df, columns)
    return (p.filter(F.abs("r") >= threshold)
             .select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"),
                     F.bround(F.abs("r"), 4).alias("correlation"), "ia", "ib")
             .orderBy("ia", "ib"))


def redundancy_decisions(pairs: list[tuple[str, str, float]], importance: dict[str, float]) -> list[dict]:
    """Greedy over (a, b, |r|) in order; skip a pair touching a dropped feature; drop the
    less important side (ties keep both; a missing importance counts as 0.0).  One dict per drop:
    dropped_feature, kept_feature, correlation, dropped_importance, kept_importance, reason.

    The fold over a list, for pairs at hand; ``resolve_redundancy`` gives the same on tables.
    """
    gone: dict[str, dict] = {}
    for a, b, r in pairs:
        weight = {f: importance.get(f, 0.0) for f in (a, b)}
        if a in gone or b in gone or weight[a] == weight[b]:
            continue
        low, high = sorted((a, b), key=weight.get)
        gone[low] = {"dropped_feature": low, "kept_feature": high, "correlation": r,
                     "dropped_importance": weight[low], "kept_importance": weight[high],
                     "reason": f"|r| {r:.4f} with {high}; importance {weight[low]:.6f} < {weight[high]:.6f}"}
    return list(gone.values())


DECISION_COLS = ["dropped_feature", "kept_feature", "correlation", "dropped_importance", "kept_importance", "reason"]


def resolve_redundancy(pairs: DataFrame, importance: DataFrame) -> DataFrame:
    """The decisions of ``redundancy_decisions`` for a pair table (feature_a, feature_b,
    correlation, ia, ib; order: ia, ib) and an importance table (feature, importance), by joins.

    A feature without importance (left join) weighs 0.0.  Rounds settle all pairs at once that are the
    first open pair of both their features, so nothing earlier can touch them; a dropped feature takes
    its later pairs with it.  Rounds follow the longest chain of pairs, not their number, and no pair
    reaches the driver.
    """
    weight = importance.groupBy("feature").agg(F.max("importance").cast("double").alias("w"))
    side = lambda f, w: weight.select(F.col("feature").alias(f), F.col("w").alias(w))
    open_pairs = written(
        pairs.join(side("feature_a", "wa"), "feature_a", "left").join(side("feature_b", "wb"), "feature_b", "left")
        .select("feature_a", "feature_b", "correlation", F.struct("ia", "ib").alias("place"),
                F.coalesce("wa", F.lit(0.0)).alias("wa"), F.coalesce("wb", F.lit(0.0)).alias("wb")), "redundant-pairs")
    a_goes = F.col("wa") < F.col("wb")
    pick = lambda x, y: F.when(a_goes, F.col(x)).otherwise(F.col(y))
    drops = None
    while not open_pairs.isEmpty():
        first = (open_pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("f"), "place")
                 .groupBy("f").agg(F.min("place").alias("first")))
        of = lambda f, name: first.select(F.col("f").alias(f), F.col("first").alias(name))
        marked = written(open_pairs.join(of("feature_a", "fa"), "feature_a").join(of("feature_b", "fb"), "feature_b")
                         .withColumn("ready", (F.col("fa") == F.col("place")) & (F.col("fb") == F.col("place"))), "redundant-marked")
        now = marked.filter("ready and wa <> wb").select(
            pick("feature_a", "feature_b").alias("dropped_feature"), pick("feature_b", "feature_a").alias("kept_feature"), "correlation",
            F.least("wa", "wb").alias("dropped_importance"), F.greatest("wa", "wb").alias("kept_importance"))
        drops = now if drops is None else drops.unionByName(now)
        gone = now.select(F.col("dropped_feature").alias("g"))
        open_pairs = written(marked.filter("not ready").join(gone, F.col("feature_a") == F.col("g"), "left_anti")
                             .join(gone, F.col("feature_b") == F.col("g"), "left_anti")
                             .select("feature_a", "feature_b", "correlation", "place", "wa", "wb"), "redundant-open")
    if drops is None:
        drops = open_pairs.select(F.col("feature_a").alias("dropped_feature"), F.col("feature_b").alias("kept_feature"), "correlation",
                                  F.col("wa").alias("dropped_importance"), F.col("wb").alias("kept_importance"))
    return drops.withColumn("reason", F.format_string(
        "|r| %.4f with %s; importance %.6f < %.6f", "correlation", "kept_feature", "dropped_importance", "kept_importance")).select(*DECISION_COLS)
