"""Running-sum metrics against brute force on small score tables, and
invariance under repartitioning."""
import numpy as np
from pyspark.sql import functions as F
import pytest

from hrlens.operators import metrics as mt


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / (len(pos) * len(neg))


def brute_ap(y, p):
    ap, P = 0.0, y.sum()
    for t in np.unique(p):
        sel = p >= t
        tp = (y[sel] == 1).sum()
        ap += (y[p == t] == 1).sum() / P * tp / sel.sum()
    return ap


def brute_opt(y, p, method="f1"):
    ths = np.clip(np.unique(np.concatenate([[0.05, 0.95], np.round(p, 4)])), 0.01, 0.99)
    best_t, best = 0.5, -1.0
    P, N = y.sum(), (1 - y).sum()
    for t in ths:
        pred = p >= t
        tp = (pred & (y == 1)).sum()
        fp = (pred & (y == 0)).sum()
        if method == "f1":
            s = 2 * tp / (tp + fp + P) if tp + fp + P else 0.0
        else:
            s = tp / max(P, 1) + (N - fp) / max(N, 1) - 1
        if s > best:
            best, best_t = s, float(t)
    return best_t, best


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_curves_and_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    y = rng.integers(0, 2, n)
    p = np.clip(np.round(rng.beta(2, 3, n) + 0.2 * y, 3 if seed == 1 else 6), 0, 1)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "model string, y int, p double")
    auc = mt.roc_auc(df).first().roc_auc
    ap = mt.average_precision(df).first().pr_auc
    assert auc == pytest.approx(brute_auc(y, p), abs=1e-12)
    assert ap == pytest.approx(brute_ap(y, p), abs=1e-12)
    for method in ("f1", "youden"):
        r = mt.optimal_threshold(df, method=method).first()
        t, s = brute_opt(y, p, method)
        assert r.threshold == pytest.approx(t, abs=1e-12)
        assert r.score == pytest.approx(s, abs=1e-12)
    for parts in (1, 7):
        again = mt.roc_auc(df.repartition(parts)).first().roc_auc
        assert again == pytest.approx(auc, abs=1e-12)


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.7)], "model string, y int, p double")
    assert mt.roc_auc(df).first().roc_auc is None


def test_calibration_bins_right_closed(spark):
    df = spark.createDataFrame([("m", 0, 0.1), ("m", 1, 0.10000001), ("m", 1, 1.0), ("m", 0, 0.0)],
                               "model string, y int, p double")
    bins = {r.bin: r.n for r in mt.calibration(df).collect()}
    assert bins == {0: 2, 1: 1, 9: 1}


def test_scores_outside_unit_interval_stay_exact(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.normal(0, 3, 300) + y, 2)          # margins, many outside [0, 1]
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "model string, y int, p double")
    assert mt.roc_auc(df).first().roc_auc == pytest.approx(brute_auc(y, p), abs=1e-12)
    assert mt.average_precision(df).first().pr_auc == pytest.approx(brute_ap(y, p), abs=1e-12)


def test_stratified_split_takes_a_label_of_many_classes(spark):
    from hrlens.operators import split as sp
    df = spark.range(60).withColumn("label", F.col("id"))
    out = sp.stratified_split(df, "label", ["id"])
    assert out.count() == 60 and out.filter("split = 'test'").count() == 12


def test_best_model_uses_unrounded_metrics(spark):
    from hrlens.operators import metrics as mt
    rows = [("a", 0.980025, 0.10, 0.5, 0.019975), ("b", 0.98, 0.90, 0.9, 0.01)]
    df = spark.createDataFrame(rows, "model string, roc_auc double, f1 double, recall double, roc_auc_gap double")
    won = mt.best_model(df.drop("roc_auc_gap"), df.select("model", "roc_auc_gap")).first()
    assert won["model"] == "a"
    from hrlens.functions.exprs import overfit_class, risk_tier
    got = spark.createDataFrame([(0.019975,), (None,)], "g double").select(overfit_class("g").alias("o"), risk_tier("g").alias("t")).collect()
    assert [tuple(r) for r in got] == [("Excellent", "Low"), (None, None)]


def test_quantiles_equal_numpy(spark):
    import numpy as np
    from hrlens.operators.quantile import quantiles, value_counts
    rng = np.random.default_rng(1)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 3, 4000), np.round(rng.lognormal(0, 3, 4000), 2))] + [(7, 5.0), (8, None)]
    counts = value_counts(spark.createDataFrame(rows, "k int, x double"), ["x"], ["k"])
    got = {r["k"]: r["q"] for r in quantiles(counts, ["k"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for k in (0, 1, 2, 7):
        want = np.quantile([x for j, x in rows if j == k], [0.0, 0.25, 0.5, 0.9, 1.0])
        assert np.allclose(got[k], want, rtol=1e-12)
    assert 8 not in got


def test_roc_vertices_keep_the_area_and_drop_straight_points(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(mt, "BUCKETS", 8)   # neighbours in other buckets
    rng = np.random.default_rng(4)
    rows = [("m", int(y), float(p)) for y, p in zip(rng.integers(0, 2, 600), rng.integers(0, 200, 600) / 200)]
    rows += [("flat", i % 2, i // 2 / 50) for i in range(100)]
    df = spark.createDataFrame(rows, "model string, y int, p double")
    got, every = mt.roc_vertices(df).collect(), mt.roc_points(df).collect()
    for m in ("m", "flat"):
        pts = sorted({(r["fpr"], r["tpr"]) for r in got if r["model"] == m})
        full = sorted({(r["fpr"], r["tpr"]) for r in every if r["model"] == m})
        area = lambda p: sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(p, p[1:]))
        assert set(pts) <= set(full) and len(pts) < len(full) and abs(area(pts) - area(full)) < 1e-12
    assert len([r for r in got if r["model"] == "flat"]) == 3   # start, first score, last score
