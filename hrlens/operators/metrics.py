"""Binary-classification evaluation as aggregations over a score table
``(group keys…, label 0/1, score)`` (M1–M14).

Curve-shaped metrics (ROC-AUC, average precision, ROC/PR points) need running
sums over scores in descending order.  They never use one window over the
whole table: rows are first reduced to one row per distinct score (partial
aggregation), then

* the distinct scores are cut at quantiles taken from the data into ``BUCKETS``
  buckets of about equal size, wherever the scores lie; per-bucket totals
  (≤ ``BUCKETS`` rows per group) give, with a small window, the counts strictly
  above each bucket;
* inside each (group, bucket) a window adds the local running sum.

The result is exact for any cut points and any number of distinct scores, and
the windows run in parallel over buckets.

A row without score (null or NaN) or without label has nothing to say about a
curve or a confusion: ``scored`` leaves it out, for all metrics alike.

The threshold search (M9) works on the 1e-4 grid the reference rounds its
candidates to, so it needs at most ~10k rows per group whatever the input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, div0, lit_d, overfit_class, r, safe_div
from ..session import cut_lineage
from .quantile import bucketed

BUCKETS = 1024

# Fixed values used by the reference's threshold routines.
THRESHOLD_GRID = [k / 100 for k in range(10, 91, 5)]          # 0.10 … 0.90 step 0.05
EXTRA_CANDIDATES = (500, 9500)                                 # 0.05 and 0.95 on the 1e-4 grid
CLIP_LOW, CLIP_HIGH = 100, 9900                                # 0.01 and 0.99 on the 1e-4 grid
CALIBRATION_BINS = 10


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


def scored(scores: DataFrame, label: str, score: str) -> DataFrame:
    """The rows with a label and a number as score."""
    p = col(score).cast("double")
    return scores.filter(p.isNotNull() & ~F.isnan(p) & col(label).isNotNull())


def confusion(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
              score: str = "p", threshold: float = 0.5, pred: str | None = None) -> DataFrame:
    """M1/M8: TN, FP, FN, TP per group; prediction = score ≥ threshold (or a given column)."""
    y = col(label)
    yhat = col(pred) if pred else (col(score) >= lit_d(threshold)).cast("int")
    return (scored(scores, label, score).groupBy(*by).agg(
        _cnt((y == 0) & (yhat == 0)).alias("tn"), _cnt((y == 0) & (yhat == 1)).alias("fp"),
        _cnt((y == 1) & (yhat == 0)).alias("fn"), _cnt((y == 1) & (yhat == 1)).alias("tp"),
        F.avg((col(score).cast("double") - y.cast("double")) ** 2).alias("brier"))
        .orderBy(*by))


def metrics_from_confusion(cm: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M2/M5: accuracy, precision, recall, F1 (0 on empty denominators), balanced
    accuracy (mean recall of the classes present), MCC (0 when undefined)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    tpr = safe_div(tp, tp + fn)
    tnr = safe_div(tn, tn + fp)
    bal = safe_div(F.coalesce(tpr, lit_d(0)) + F.coalesce(tnr, lit_d(0)),
                   tpr.isNotNull().cast("int") + tnr.isNotNull().cast("int"))
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return cm.select(
        *by, "tn", "fp", "fn", "tp",
        div0(tp + tn, n).alias("accuracy"), div0(tp, tp + fp).alias("precision"),
        div0(tp, tp + fn).alias("recall"), div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        bal.alias("balanced_accuracy"),
        F.when(mcc_den == 0, lit_d(0.0)).otherwise((tp * tn - fp * fn) / mcc_den).alias("mcc"),
        *([F.col("brier").alias("brier_score")] if "brier" in cm.columns else []))


def _distinct_scores(scores: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """One row per (group, distinct score): positives and negatives at that score."""
    y = col(label).cast("long")
    return scored(scores, label, score).groupBy(*by, col(score).cast("double").alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def cumulative(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
               score: str = "p", bucket: bool = False) -> DataFrame:
    """Per (group, distinct score s): pos, neg and tp/fp = counts with score ≥ s, plus P, N (and on
    request the score's bucket ``b``).

    Exact two-level running sum (bucket totals + in-bucket window), see module doc.  The cut
    points are ``BUCKETS - 1`` numbers per table, shared by all groups.
    """
    by = list(by)
    d = cut_lineage(_distinct_scores(scores, by, label, score))  # read three times from here
    d = bucketed(d, "s", "b", BUCKETS)
    t = d.groupBy(*by, "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = Window.partitionBy(*by).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    t = t.select(*by, "b",
                 F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("pos_above"),
                 F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("neg_above"),
                 F.sum("bp").over(whole).alias("P"), F.sum("bn").over(whole).alias("N"))
    inb = Window.partitionBy(*by, "b").orderBy(F.desc("s")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (d.join(t, [*by, "b"])
             .select(*by, *(["b"] if bucket else []), "s", "pos", "neg", "P", "N",
                     (F.col("pos_above") + F.sum("pos").over(inb)).alias("tp"),
                     (F.col("neg_above") + F.sum("neg").over(inb)).alias("fp")))


def roc_auc(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
            score: str = "p") -> DataFrame:
    """M3: ROC-AUC with ties counted half; null when a class is absent."""
    c = cumulative(scores, by, label, score)
    num = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / lit_d(2.0)))
    return c.groupBy(*by).agg(safe_div(num, F.max("P").cast("double") * F.max("N")).alias("roc_auc"))


def average_precision(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                      score: str = "p") -> DataFrame:
    """M4: step-wise average precision Σ ΔR·P over distinct thresholds (not a trapezoid)."""
    c = cumulative(scores, by, label, score)
    prec = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    return c.groupBy(*by).agg(
        safe_div(F.sum(F.col("pos") * prec), F.max("P")).alias("pr_auc"))


def curve_metrics(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                  score: str = "p") -> DataFrame:
    """M3 + M4 from ONE cumulative table: (group, roc_auc, pr_auc)."""
    c = cumulative(scores, by, label, score)
    num = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / lit_d(2.0)))
    prec = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    return c.groupBy(*by).agg(
        safe_div(num, F.max("P").cast("double") * F.max("N")).alias("roc_auc"),
        safe_div(F.sum(F.col("pos") * prec), F.max("P")).alias("pr_auc"))


def roc_points(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
               score: str = "p") -> DataFrame:
    """M6: (threshold, fpr, tpr) per distinct score, plus the (inf, 0, 0) start point."""
    c = cumulative(scores, by, label, score)
    pts = c.select(*by, F.col("s").alias("threshold"), safe_div("fp", "N").alias("fpr"),
                   safe_div("tp", "P").alias("tpr"))
    start = c.groupBy(*by).agg(F.lit(float("inf")).alias("threshold"), lit_d(0.0).alias("fpr"),
                               lit_d(0.0).alias("tpr"))
    return pts.unionByName(start)


def roc_vertices(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                 score: str = "p") -> DataFrame:
    """M6 as plotted: ``roc_points`` without the points on a straight line between their neighbours.

    A point lies on one when the next lower score adds the same positives and negatives as the point's
    own; the first and the last score always stay.  The next score of a bucket's last row is the first
    of the next bucket, so only one row a bucket crosses buckets.
    """
    by = list(by)
    c = cumulative(scores, by, label, score, bucket=True)
    own = F.struct("pos", "neg")
    below = Window.partitionBy(*by).orderBy(F.desc("b"))
    first = c.groupBy(*by, "b").agg(F.max_by(own, "s").alias("_f")).select(*by, "b", F.lead("_f").over(below).alias("_over"))
    c = c.join(first, [*by, "b"])
    after = F.coalesce(F.lead(own).over(Window.partitionBy(*by, "b").orderBy(F.desc("s"))), F.col("_over"))
    at_start = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    kept = c.withColumn("_next", after).filter(at_start | F.col("_next").isNull() | (F.col("_next") != own))
    pts = kept.select(*by, F.col("s").alias("threshold"), safe_div("fp", "N").alias("fpr"), safe_div("tp", "P").alias("tpr"))
    start = c.select(*by).distinct().select(*by, F.lit(float("inf")).alias("threshold"), lit_d(0.0).alias("fpr"), lit_d(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_points(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
              score: str = "p") -> DataFrame:
    """M6: (threshold, precision, recall) per distinct score, plus the (recall 0, precision 1) end."""
    c = cumulative(scores, by, label, score)
    pts = c.select(*by, F.col("s").alias("threshold"),
                   div0("tp", F.col("tp") + F.col("fp")).alias("precision"),
                   F.coalesce(safe_div("tp", "P"), lit_d(1.0)).alias("recall"))
    end = c.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"),
                             lit_d(1.0).alias("precision"), lit_d(0.0).alias("recall"))
    return pts.unionByName(end)


def calibration(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                score: str = "p", n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """M7: uniform bins, right-closed inner edges (bin = number of edges below p); empty bins absent."""
    scores = scored(scores, label, score)
    p = col(score).cast("double")
    step = 1.0 / n_bins
    binid = sum(((p > F.lit(i) * lit_d(step)).cast("int") for i in range(1, n_bins)), F.lit(0))
    return (scores.groupBy(*by, binid.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col(label).cast("double")).alias("fraction_positive"),
        F.avg(p).alias("mean_predicted")).orderBy(*by, "bin"))


def _grid_slot(p: Column) -> Column:
    """Largest k with k/10000.0 ≤ p (exact comparison with the double candidate)."""
    k0 = F.floor(p * lit_d(10000.0))
    return (F.when((k0 + 1) / lit_d(10000.0) <= p, k0 + 1)
             .when(k0 / lit_d(10000.0) > p, k0 - 1).otherwise(k0))


def optimal_threshold(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                      score: str = "p", method: str = "f1") -> DataFrame:
    """M9: best threshold among {0.05, 0.95} ∪ round(p, 4), clipped to [0.01, 0.99].

    Maximises F1 (or Youden's J); the lowest threshold wins ties; predictions
    use the unrounded score.  Rows are reduced to ≤ ~9.8k grid slots per group
    before any window, so the search is bounded whatever the input size.
    """
    by = list(by)
    p = col(score).cast("double")
    y = col(label).cast("long")
    base = scored(scores, label, score).select(*by, p.alias("p"), y.alias("y"))
    slots = (base.groupBy(*by, F.least(F.greatest(_grid_slot(F.col("p")), F.lit(CLIP_LOW - 1)),
                                       F.lit(CLIP_HIGH + 1)).cast("long").alias("k"))
             .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
             .withColumn("cand", F.lit(0)))
    rounded = F.rint(F.col("p") * lit_d(10000.0))
    cands = base.select(*by, F.least(F.greatest(rounded, lit_d(CLIP_LOW)), lit_d(CLIP_HIGH))
                        .cast("long").alias("k"))
    groups = base.select(*by).distinct()
    for extra in EXTRA_CANDIDATES:
        cands = cands.unionByName(groups.select(*by, F.lit(extra).cast("long").alias("k")))
    cands = cands.distinct().select(*by, "k", F.lit(0).cast("long").alias("pos"),
                                    F.lit(0).cast("long").alias("neg"), F.lit(1).alias("cand"))
    w = Window.partitionBy(*by).orderBy(F.desc("k"), F.asc("cand")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    u = slots.unionByName(cands).select(
        *by, "k", "cand", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
        F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    tp, fp, P, N = (F.col(c).cast("double") for c in ("tp", "fp", "P", "N"))
    f1 = div0(2 * tp, tp + fp + P)
    prec, rec = div0(tp, tp + fp), div0(tp, P)
    if method == "youden":
        sc = tp / F.greatest(P, lit_d(1.0)) + (N - fp) / F.greatest(N, lit_d(1.0)) - lit_d(1.0)
    elif method == "f1":
        sc = f1
    else:
        raise ValueError(f"unknown method {method!r}")
    c = u.filter(F.col("cand") == 1).select(*by, "k", f1.alias("f1"), prec.alias("precision"),
                                            rec.alias("recall"), sc.alias("score"))
    best = c.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("ns"), F.col("k").alias("k"),
                                             "f1", "precision", "recall", "score")).alias("b"))
    found = F.col("b.score") > lit_d(-1.0)
    return best.select(
        *by,
        F.when(found, F.col("b.k") / lit_d(10000.0)).otherwise(lit_d(0.5)).alias("threshold"),
        F.when(found, F.col("b.f1")).alias("f1"), F.when(found, F.col("b.precision")).alias("precision"),
        F.when(found, F.col("b.recall")).alias("recall"), F.when(found, F.col("b.score")).alias("score"))


def threshold_table(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                    score: str = "p", thresholds: Sequence[float] = THRESHOLD_GRID) -> DataFrame:
    """Precision, recall, F1, balanced accuracy at each fixed threshold.

    Each row is counted once, in the slot of the highest threshold it reaches; running sums over
    the (number of thresholds + 1) slots of a group give all confusions.
    """
    by = list(by)
    cuts = sorted({float(t) for t in thresholds})
    p, y = col(score).cast("double"), col(label)
    slot = sum(((p >= lit_d(t)).cast("int") for t in cuts), F.lit(0))
    slots = (scored(scores, label, score).groupBy(*by, slot.alias("slot"))
             .agg(_cnt(y == 1).alias("pos"), _cnt(y == 0).alias("neg")))
    # one row per group: counts by slot, then one row per threshold
    at = {i: (F.sum(F.when(F.col("slot") > i, F.col("pos")).otherwise(0)), F.sum(F.when(F.col("slot") > i, F.col("neg")).otherwise(0)))
          for i in range(len(cuts))}
    wide = slots.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.array(*[
        F.struct(lit_d(t).alias("threshold"), at[i][0].alias("tp"), at[i][1].alias("fp")) for i, t in enumerate(cuts)]).alias("rows"))
    cm = wide.select(*by, "P", "N", F.explode("rows").alias("r")).select(
        *by, F.col("r.threshold").alias("threshold"), (F.col("N") - F.col("r.fp")).alias("tn"), F.col("r.fp").alias("fp"),
        (F.col("P") - F.col("r.tp")).alias("fn"), F.col("r.tp").alias("tp"))
    m = metrics_from_confusion(cm, [*by, "threshold"])
    return m.select(*by, "threshold", "precision", "recall", "f1", "balanced_accuracy")


def scalar_metrics(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                   score: str = "p", threshold: float = 0.5) -> DataFrame:
    """M2/M5 + M3/M4: the eight comparison metrics and the Brier score per group."""
    m = metrics_from_confusion(confusion(scores, by, label, score, threshold), by)
    return m.join(curve_metrics(scores, by, label, score), list(by))


def metrics_comparison(scores: DataFrame, by: str = "model", label: str = "y", score: str = "p",
                       threshold: float = 0.5, digits: int = 4) -> DataFrame:
    """Eight metrics rounded to ``digits``, sorted by ROC-AUC then PR-AUC (desc)."""
    m = scalar_metrics(scores, [by], label, score, threshold)
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "balanced_accuracy", "mcc"]
    return (m.select(by, *[F.bround(c, digits).alias(c) for c in names])
             .orderBy(F.desc("roc_auc"), F.desc("pr_auc"), by))


def overfit_report(train_scores: DataFrame, test_scores: DataFrame, by: str = "model",
                   label: str = "y", score: str = "p", threshold: float = 0.5, digits: int | None = 4) -> DataFrame:
    """Train and test AUC, their gap, its class (of the unrounded gap), and train and test F1."""
    def side(scores: DataFrame, name: str) -> DataFrame:
        f1 = metrics_from_confusion(confusion(scores, [by], label, score, threshold), [by])
        return roc_auc(scores, [by], label, score).join(f1.select(by, "f1"), by).select(
            by, F.col("roc_auc").alias(f"{name}_roc_auc"), F.col("f1").alias(f"{name}_f1"))

    gap = F.col("train_roc_auc") - F.col("test_roc_auc")
    shown = (lambda c: c) if digits is None else (lambda c: r(c, digits))
    return (side(train_scores, "train").join(side(test_scores, "test"), by, "full")
            .select(by, *[shown(F.col(c)).alias(c) for c in ("train_roc_auc", "test_roc_auc")],
                    shown(gap).alias("roc_auc_gap"), overfit_class(gap).alias("overfit_class"),
                    *[shown(F.col(c)).alias(c) for c in ("train_f1", "test_f1")]))


def best_model(metrics: DataFrame, gaps: DataFrame | None = None, by: str = "model", digits: int = 4) -> DataFrame:
    """Max by (ROC-AUC, F1, recall, −gap; missing gap = 0) over unrounded metrics, plus a
    computed rationale; the numbers shown are rounded to ``digits``."""
    c = metrics
    if gaps is not None:
        c = c.join(gaps.select(by, "roc_auc_gap"), by, "left")
    else:
        c = c.withColumn("roc_auc_gap", lit_d(0.0))
    c = c.withColumn("roc_auc_gap", F.coalesce("roc_auc_gap", lit_d(0.0)))
    key = F.struct(F.col("roc_auc").alias("a"), F.col("f1").alias("b"), F.col("recall").alias("c"),
                   (-F.col("roc_auc_gap")).alias("d"), F.col(by).alias("m"))
    stats = c.agg(F.max(key).alias("w"), F.max("f1").alias("best_f1"), F.max("recall").alias("best_recall"))
    won = c.join(stats, F.col(by) == F.col("w.m"))
    shown = {k: F.bround(k, digits) for k in ("roc_auc", "f1", "recall", "roc_auc_gap")}
    text = F.format_string(
        "%s selected: highest test ROC-AUC (%.4f); F1 %.4f%s; recall %.4f%s; train-test ROC-AUC gap %.4f.",
        F.col(by), shown["roc_auc"], shown["f1"],
        F.when(F.col("f1") >= F.col("best_f1"), F.lit(" (best)")).otherwise(F.lit("")),
        shown["recall"],
        F.when(F.col("recall") >= F.col("best_recall"), F.lit(" (highest)")).otherwise(F.lit("")),
        shown["roc_auc_gap"])
    return won.select(by, *[v.alias(k) for k, v in shown.items()], text.alias("rationale"))
