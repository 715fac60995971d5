"""Trees, forests, boosting and batched logistic regression against plain NumPy and single fits."""
import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hrlens.plans import logistic, modeling as ml, trees as tr

N, D = 2000, 7


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=N), rng.integers(0, 4, N), rng.exponential(size=N).round(2), rng.integers(0, 2, N),
                         rng.normal(size=N).round(1), np.full(N, 3.0), rng.integers(0, 30, N)]).astype(float)
    z = x[:, 0] + 0.8 * (x[:, 1] == 2) - 0.6 * x[:, 2] * x[:, 3] + 0.3 * rng.normal(size=N)
    y = (z + rng.logistic(size=N) * 0.7 > 0.9).astype(int)
    return x, y, np.arange(N) % 3


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, fold = data
    rows = [(int(i) * 7919 + 13, int(y[i]), int(fold[i]), x[i].tolist(), x[i].tolist(), x[i].tolist()) for i in range(N)]
    df = spark.createDataFrame(rows, "h long, y int, fold int, x0 array<double>, x1 array<double>, x2 array<double>").repartition(5, "h")
    return tr.binned(df, ["x0", "x1", "x2"], bins=32)


def _inputs(table, fold):
    got = sorted(table.rows.select("h", "y", "fold", f"x{fold}").collect(), key=lambda r: r["h"])
    x = np.array([list(r[f"x{fold}"]) for r in got], int)
    return x, np.array([r["y"] for r in got]), np.array([r["fold"] for r in got]), np.array([r["h"] for r in got])


def brute_tree(x, one, two, rows, e, tree, n_bins, node_place=1, depth=0):
    """A tree by trying every feature and every border on the rows themselves."""
    s = (one[rows].sum(), two[rows].sum(), len(rows))
    node = {"stats": s, "depth": depth}
    pure = e.kind == "gini" and min(s[:2]) <= tr.FLAT
    if depth >= e.depth or s[2] < max(e.min_split, 2 * e.min_leaf) or pure:
        return node
    if e.kind == "gini":
        cost = lambda a, b: 2 * a * b / (a + b) if a + b > 0 else 0.0
    else:
        cost = lambda g, h: -0.5 * g * g / (h + e.l2)
    found = []
    for f in tr._columns_of(e, tree, node_place, x.shape[1]):
        for c in range(n_bins[f] - 1):
            left = rows[x[rows, f] <= c]
            right = rows[x[rows, f] > c]
            if min(len(left), len(right)) < max(1, e.min_leaf):
                continue
            a, b = (one[left].sum(), two[left].sum()), (one[right].sum(), two[right].sum())
            if e.kind == "logistic" and min(a[1], b[1]) < e.min_hessian:
                continue
            found.append((cost(s[0], s[1]) - cost(*a) - cost(*b), int(f), c, left, right))
    top = max((g[0] for g in found), default=0.0)
    scale = s[0] + s[1] if e.kind == "gini" else 2 * abs(cost(s[0], s[1]))
    if top > (tr.FLAT * scale if e.kind == "gini" else 1e-9):
        gain, f, c, left, right = next(g for g in found if g[0] >= top - 1e-11 * (scale + top))   # ties: the first
        node.update(feature=f, cut=c, gain=gain,
                    left=brute_tree(x, one, two, left, e, tree, n_bins, 2 * node_place, depth + 1),
                    right=brute_tree(x, one, two, right, e, tree, n_bins, 2 * node_place + 1, depth + 1))
    return node


def same(t, node, j=0):
    assert t.stats[j] == pytest.approx(node["stats"], rel=1e-9, abs=1e-9)
    if "feature" not in node:
        assert t.feature[j] == -1
        return 1
    assert (t.feature[j], t.cut[j]) == (node["feature"], node["cut"]) and t.gain[j] == pytest.approx(node["gain"])
    return 1 + same(t, node["left"], t.left[j]) + same(t, node["right"], t.left[j] + 1)


def values(node, e, x):
    if "feature" in node:
        go = x[:, node["feature"]] <= node["cut"]
        return np.where(go, values(node["left"], e, x), values(node["right"], e, x))
    g, h, _ = node["stats"]
    return np.full(len(x), -e.rate * g / (h + e.l2))


GINI = [tr.Ensemble("gini", 0, (0.7, 1.6), depth=6), tr.Ensemble("gini", 1, (0.7, 1.6), depth=30, min_split=25, min_leaf=8),
        tr.Ensemble("gini", 2, (0.7, 1.6), trees=3, depth=5, min_split=10, rows="poisson", columns=2, seed=9)]


def test_trees_and_forests_equal_brute_force(table):
    grown = tr.grow(table, GINI)
    for e, ts in zip(GINI, grown):
        x, y, fold, h = _inputs(table, e.fold)
        n_bins = np.diff(table.layout(e.fold))
        assert len(ts) == e.trees
        for i, t in enumerate(ts):
            times = tr._drawn(e, i, h)
            w = times * np.where(y == 1, e.weights[1], e.weights[0])
            rows = np.flatnonzero((fold != e.fold) & (times > 0))
            assert same(t, brute_tree(x, w * (y == 0), w * (y == 1), rows, e, i, n_bins)) == len(t.feature) > 5
            inner = [j for j, f in enumerate(t.feature) if f >= 0]
            assert all(t.stats[j][2] >= e.min_split for j in inner)
            assert all(t.stats[t.left[j] + s][2] >= e.min_leaf for j in inner for s in (0, 1))


BOOSTED = [tr.Ensemble("logistic", 0, (1.0, 1.7), trees=11, depth=3, rate=0.3, rows=0.8, columns=0.8, seed=3),
           tr.Ensemble("logistic", 1, (1.0, 1.0), trees=4, depth=5, rate=0.1)]


def test_boosting_equals_brute_force(table):
    """Second-order boosting, also beyond the round in which margins are written."""
    grown = tr.grow(table, BOOSTED)
    for e, ts in zip(BOOSTED, grown):
        x, y, fold, h = _inputs(table, e.fold)
        margin = np.zeros(len(y))
        for i, t in enumerate(ts):
            times = tr._drawn(e, i, h)
            p = 1 / (1 + np.exp(-margin))
            w = times * np.where(y == 1, e.weights[1], e.weights[0])
            want = brute_tree(x, w * (p - y), w * p * (1 - p), np.flatnonzero((fold != e.fold) & (times > 0)), e, i, np.diff(table.layout(e.fold)))
            assert same(t, want) == len(t.feature)
            margin += values(want, e, x)


def _scores(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["model"], r["fold"]), []).append((r["y"], round(r["p"], 12)))
    return {k: sorted(v) for k, v in out.items()}


def test_cuts_equal_ensembles_of_their_own(table):
    """Fewer trees, less depth, a larger minimum split: cuts of one ensemble score like ensembles that
    were grown with these parameters."""
    big = [tr.Ensemble("gini", 0, (0.7, 1.6), trees=6, depth=8, rows="poisson", columns=2),
           tr.Ensemble("logistic", 1, (1.0, 1.7), trees=9, depth=3, rows=0.8, columns=0.8)]
    own = [tr.refit(big[0], trees=4, depth=4, min_split=40), tr.refit(big[0], trees=6, depth=8, min_split=12), tr.refit(big[1], trees=5)]
    cuts = [tr.Cut("a", 0, 4, 4, 40), tr.Cut("b", 0, 6, 8, 12), tr.Cut("c", 1, 5)]
    whole = [tr.Cut(n, i, e.trees) for i, (n, e) in enumerate(zip("abc", own))]
    grown = tr.grow(table, big)
    got = _scores(tr.held_out_scores(table, big, grown, cuts))
    want = _scores(tr.held_out_scores(table, own, tr.grow(table, own), whole))
    assert got == want and len(got) == 3 and all(len(v) in (666, 667) for v in got.values())
    cut = tr.trimmed(grown[0][0], 4, 40)
    alone = tr.grow(table, [tr.refit(big[0], trees=1, depth=4, min_split=40)])[0][0]
    assert (cut.feature, cut.cut, cut.depth) == (alone.feature, alone.cut, alone.depth)


def test_growth_does_not_depend_on_parts_or_passes(table, monkeypatch):
    want = tr.grow(table, GINI[:1])[0][0]
    monkeypatch.setattr(tr, "CELLS", 500)
    other = tr.Binned(table.rows.repartition(2), table.edges)
    got = tr.grow(other, GINI[:1] * 2)
    assert [(t.feature, t.cut) for ts in got for t in ts] == [(want.feature, want.cut)] * 2


def test_one_class_and_no_rows(spark, table):
    one = tr.Binned(table.rows.withColumn("y", F.lit(0)), table.edges)
    t = tr.grow(one, [tr.Ensemble("gini", 0), tr.Ensemble("logistic", 0, trees=2, depth=2)])
    assert t[0][0].feature == [-1] and len(t[1]) == 2
    none = tr.Binned(table.rows.filter("y = 5"), table.edges)
    assert tr.grow(none, [tr.Ensemble("gini", 0)])[0][0].feature == [-1]


def test_batched_logistic_equals_single_fits(spark, data):
    x, y, fold = data
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    df = spark.createDataFrame([(int(y[i]), int(fold[i]), *[x[i].tolist()] * 3, *x[i].tolist()) for i in range(N)],
                               "y int, fold int, x0 array<double>, x1 array<double>, x2 array<double>, " + ", ".join(f"c{j} double" for j in range(D))).repartition(4)
    pairs = [(c, f) for c in (0.01, 0.1, 1.0, 10.0) for f in range(3)]
    weights = {f: w for f, (w, _) in ml.fold_weights(df, range(3)).items()}
    fits = logistic.fit_many(df, pairs, weights)
    rows = VectorAssembler(inputCols=[f"c{j}" for j in range(D)], outputCol="features").transform(df)
    for fit in fits:
        w0, w1 = fit.weights
        inside = rows.filter(F.col("fold") != fit.fold).withColumn("w", F.when(F.col("y") == 1, w1).otherwise(w0))
        one = LogisticRegression(labelCol="y", weightCol="w", standardization=False, maxIter=2000, tol=1e-14,
                                 regParam=1 / (fit.C * inside.count())).fit(inside)
        assert np.abs(fit.beta[:-1] - one.coefficients.toArray()).max() < 1e-6 and abs(fit.beta[-1] - one.intercept) < 1e-6
        assert fit.passes < 15
    scores = logistic.held_out_scores(df, fits).groupBy("model", "fold").count().collect()
    assert len(scores) == 12 and sum(r["count"] for r in scores) == 4 * N


def test_tree_pipeline_saves_and_scores(spark, data):
    x, y, fold = data
    df = spark.createDataFrame([(i, int(y[i]), "ab"[int(x[i, 3])], *map(float, x[i, [0, 2, 6]]), int(fold[i])) for i in range(N)],
                               "id int, label int, k string, u double, v double, w double, fold int")
    for name, candidate in (("decision_tree", {"max_depth": 5, "min_samples_split": 10, "min_samples_leaf": 5}),
                            ("random_forest", {"n_estimators": 4, "max_depth": 5, "min_samples_split": 2, "max_features": "sqrt"}),
                            ("gradient_boosting", {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.8})):
        model, state, n = ml.fit_candidate(ml.ModelSpec(name), candidate, df, ["k"], ["u", "v", "w"])
        path = tempfile.mkdtemp(prefix="hrlens-trees-") + "/m"
        model.save(path)
        back = PipelineModel.load(path)
        p = [vector_to_array("probability")[1].alias("p")]
        a, b = (sorted((r["id"], r["p"]) for r in m.transform(df).select("id", *p).collect()) for m in (model, back))
        assert a == b and n == N
        at = {i: v for i, v in a}
        pos, neg = (np.array([at[i] for i in range(N) if y[i] == k]) for k in (1, 0))
        assert (pos[:, None] > neg[None, :]).mean() > 0.7
        assert model.stages[-1].featureImportances.toArray().sum() == pytest.approx(1.0)
        assert len(model.stages[-1].featureImportances) == len(state.output_names())


def test_search_scores_every_candidate(spark, data):
    x, y, fold = data
    df = spark.createDataFrame([(i, int(y[i]) if i % 50 else None, "ab"[int(x[i, 3])], *map(float, x[i, [0, 2, 6]]), int(fold[i])) for i in range(N)],
                               "id int, label int, k string, u double, v double, w double, fold int")
    for spec in ml.model_specs(full_grid=False):
        got = ml.search(spec, df, ["k"], ["u", "v", "w"], folds=3)
        assert len(got) == len(spec.grid) and all(0.6 < a < 1 for a in got)
    assert [len(s.grid) for s in ml.model_specs()] == [4, 45, 54, 108]


@pytest.mark.parametrize("columns", [None, 3])
def test_passes_do_not_grow_with_the_number_of_nodes(table, monkeypatch, columns):
    """Levels that would need many passes leave their small nodes to tasks that grow them to the end."""
    e = [tr.Ensemble("gini", 1, (1.0, 1.7), trees=2, depth=30, min_leaf=m, columns=columns, rows="poisson" if columns else None) for m in (1, 4)]
    want = tr.grow(table, e)
    monkeypatch.setattr(tr, "CELLS", int(table.layout(1)[-1]) * 8)
    monkeypatch.setattr(tr, "SMALL", 300)
    context, passes = type(table.rows.sparkSession.sparkContext), []
    send = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: (passes.append(1), send(self, value))[1])
    got = tr.grow(table, e)
    assert len(passes) < 40
    for a, b in zip(sum(want, []), sum(got, [])):
        assert (a.feature, a.cut, a.left, a.depth, a.place) == (b.feature, b.cut, b.left, b.depth, b.place)
        assert np.array(a.stats) == pytest.approx(np.array(b.stats), rel=1e-9, abs=1e-9)
        assert a.gain == pytest.approx(b.gain, rel=1e-6, abs=1e-9) and not b.open


def test_importance_is_that_of_a_forest_whatever_the_partitions(spark, data):
    """Close to Spark ML's forest of the same size; the draws go by row, so partitions change nothing."""
    from pyspark.ml.classification import RandomForestClassifier
    x, y, _ = data
    few = np.column_stack([x[:, 0].round(), x[:, 1], x[:, 2].round().clip(0, 3), x[:, 6] // 3])   # bins are the values
    df = spark.createDataFrame([(i, int(y[i]), "ab"[int(x[i, 3])], *map(float, few[i])) for i in range(N)],
                               "id int, label int, k string, u double, v double, w double, z double")
    names = ["u", "v", "w", "z"]
    got, other = ([tuple(r) for r in ml.rf_importance(df.repartition(p), ["k"], names, num_trees=40, max_depth=6).collect()] for p in (3, 7))
    assert got == other and sum(v for _, v in got) == pytest.approx(1, abs=1e-5)
    state, _, rows, _ = ml._encoded(False, df, ["k"], names, "label")
    want = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=40, maxDepth=6, seed=1).fit(rows)
    for name, v in ml.importances(want, state.output_names()):
        assert dict(got)[name] == pytest.approx(v, abs=0.03)


def test_forest_sums_hold_the_columns_looked_at(table, monkeypatch):
    """A task's sums, handed over in parts, add up to those of the rows; no other column's cells are sent."""
    e = tr.Ensemble("gini", 1, (0.7, 1.6), trees=2, columns=3, rows="poisson", seed=5)
    x, y, fold, h = _inputs(table, 1)
    first = table.layout(1)
    t = {"feature": np.array([0, -1, -1]), "cut": np.array([9, 0, 0]), "left": np.array([1, 0, 0]), "depth": np.array([0, 1, 1])}
    looks = tr._columns_of_nodes(e, 1, [2, 3], D)
    assert [v.tolist() for v in looks] == [tr._columns_of(e, 1, p, D).tolist() for p in (2, 3)]
    monkeypatch.setattr(tr, "FLUSH", 700)
    parts = [tr.pa.RecordBatch.from_pylist([{"h": h[a:a + 300].tobytes(), "y": y[a:a + 300].astype(np.int32).tobytes(), "x1": x[a:a + 300].astype(np.uint8).tobytes(),
                                             "fold": fold[a:a + 300].astype(np.int32).tobytes()}]) for a in range(0, N, 300)]
    got, n = {}, 0
    for batch in tr._forest_histograms([e], {0: first}, [(0, 1, t, np.array([1, 2]), looks)])(iter(parts)):
        n += 1
        for r in batch.to_pylist():
            got[r["node"]] = got.get(r["node"], 0) + np.frombuffer(r["cells"]).reshape(-1, 3)
    assert n == 3
    times = tr._drawn(e, 1, h)
    assert times.tolist() == np.searchsorted(tr._POISSON, tr.uniform(h.view(np.uint64), e.seed * 7_919 + 1), side="right").tolist()
    for j in (0, 1):
        rows = np.flatnonzero((times > 0) & (fold != 1) & ((x[:, 0] > 9) == j))
        w = times[rows] * np.where(y[rows] == 1, 1.6, 0.7)
        want = [np.stack([np.bincount(x[rows, c], v, first[c + 1] - first[c]) for v in (w * (y[rows] == 0), w * (y[rows] == 1), np.ones(len(rows)))], 1) for c in looks[j]]
        assert got[j] == pytest.approx(np.concatenate(want))


def test_blocks_are_cut_and_dealt_evenly(spark, table):
    """A large batch does not become one large block, and one partition's blocks go to all cores."""
    sizes = [b.num_rows for b in tr._blocks(iter([tr.pa.RecordBatch.from_pydict({"v": np.arange(n)}) for n in (100_000, 10_000, 10_000, 5)]))]
    assert sum(sizes) == 120_005 and max(sizes) <= 1.5 * tr.BLOCK
    packed = tr._packed(table.rows.coalesce(1), [1])
    assert packed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sum(len(r["y"]) // 4 for r in packed.collect()) == N


def test_draws_at_the_borders_are_exact():
    h = np.arange(300_000, dtype=np.int64) * 982_451_653
    e = tr.Ensemble("gini", 1, rows="poisson", seed=9)
    got = tr._poisson(e, 3, h)
    assert got.tolist() == np.searchsorted(tr._POISSON, tr.uniform(h.view(np.uint64), e.seed * 7_919 + 3), side="right").tolist()


def test_single_trees_are_searched_in_few_passes(table, monkeypatch):
    """Small nodes of single trees are grown and scored where their rows meet: two passes in place of one a level, the
    same scores for every cut, and no node below a waiting one on the driver."""
    es = [tr.Ensemble("gini", f, (0.7, 1.6), min_leaf=m) for f in (0, 1) for m in (1, 6)]
    cuts = [tr.Cut(f"{k} {depth} {least}", k, 1, depth, least) for k in range(4) for depth in (2, 5, 30) for least in (2, 40)]
    monkeypatch.setattr(tr, "SINGLE", 0)
    whole = tr.grow(table, es)
    want = _scores(tr.held_out_scores(table, es, whole, cuts))
    monkeypatch.setattr(tr, "SINGLE", N)
    passes, level = [], tr._level
    monkeypatch.setattr(tr, "_level", lambda *a: (passes.append(1), level(*a))[1])
    later: dict = {}
    top = tr.grow(table, es, later)
    assert len(passes) <= 2 and sorted(later) == [0, 1, 2, 3]
    assert sum(len(t.feature) for ts in top for t in ts) < 0.2 * sum(len(t.feature) for ts in whole for t in ts)
    assert _scores(tr.held_out_scores(table, es, top, cuts, later)) == want
    for a, b in zip(whole, tr.grow(table, es)):
        assert (a[0].feature, a[0].cut, a[0].left, a[0].place) == (b[0].feature, b[0].cut, b[0].left, b[0].place)
        assert np.array(a[0].stats) == pytest.approx(np.array(b[0].stats), rel=1e-9, abs=1e-9)


def test_ranked_borders_are_the_quantiles(spark, data, monkeypatch):
    """Exact with few distinct values, near the rank with many, and the same however the summaries are merged."""
    x, _, fold = data
    df = spark.createDataFrame([(int(fold[i]), x[i].tolist(), (x[i] * 2).tolist()) for i in range(N)], "fold int, x0 array<double>, x1 array<double>").repartition(3, "fold")
    want = lambda v, at: sorted({float(v[at(k, len(v))]) for k in range(1, 64)} - {float(v[-1])})
    got = tr.ranked_borders(df, {"x0": D, "x1": D})
    for f, times in (("x0", 1), ("x1", 2)):
        v = np.sort(times * x[fold != int(f[1])], axis=0)
        assert got[f] == [want(v[:, j], lambda k, n: -(-k * n // 64) - 1) for j in range(D)]
    monkeypatch.setattr(tr, "POINTS", 100)
    v, n = tr._summary(np.arange(1000.0)[::-1].copy(), np.ones(1000, np.int64))
    assert len(v) <= 100 and n.sum() == 1000 and v[-1] == 999 and n.max() <= 10 and (np.cumsum(n) == v + 1).all()
    assert tr.ranked_borders(df.filter("fold = 5"), {"x0": 2}) == {"x0": [[], []]}
