"""Folds, fold-wise encoding, training, evaluation, saving and scoring."""
import math
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hrlens.operators import encode as enc
from hrlens.operators import features as fe
from hrlens.operators import metrics as mt
from hrlens.operators import split as sp
from hrlens.plans import catalog as C
from hrlens.plans import modeling as ml
from hrlens.plans import pipelines as pl


@pytest.fixture(scope="module")
def trained(spark):
    """Selection, training (two quick models, five folds), evaluation, everything saved."""
    out = tempfile.mkdtemp(prefix="hrlens-bundle-")
    res = pl.run_feature_engineering(C.O(spark, SF_SMALL), "id", C.ML_NOMINAL, C.ML_NUMERIC, num_trees=5, max_depth=4, out_dir=out)
    ev = pl.run_evaluation(res, C.ML_NOMINAL, "id", full_grid=False, models=["logistic_regression"], out_dir=out)
    return out, res, ev


def test_default_folds_and_models(spark, trained):
    _, res, ev = trained
    assert 0.0 <= ev["trained"][0].cv_auc <= 1.0
    n = res["featured"].count()
    assert ev["scores"].count() == n and ev["scores"].filter("p is null").count() == 0  # no row is left out
    row = ev["comparison"].first()
    test = ev["scores"].filter("split = 'test'")
    assert row["roc_auc"] == pytest.approx(mt.roc_auc(test).first()["roc_auc"])
    assert 0.01 <= ev["threshold"] <= 0.99
    assert len([x for x in ml.model_specs() if x.grid]) == 4
    assert [len(x.grid) for x in ml.model_specs()] == [4, 45, 54, 108]


def test_importance_ranks(spark, trained):
    _, res, ev = trained
    top = ml.feature_importance(ev["trained"][0], top_n=5).collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]
    assert all(top[i]["importance"] >= top[i + 1]["importance"] for i in range(4))
    names = [r["feature"] for r in res["importance"].collect()]
    assert "WorkLifeBalance" in names and "WorkLifeBalance_missing" in names


def test_saved_bundle_scores_raw_rows(spark, trained):
    out, res, ev = trained
    bundle = pl.load_bundle(spark, out)
    assert bundle.threshold == ev["threshold"]
    unused = set(res["dropped"]) - {b for f in fe.ENGINEERED if f in res["selected"] for b in fe.INPUTS_OF[f]}
    assert bundle.input_columns == [c for c in C.ML_NOMINAL + C.ML_NUMERIC if c not in unused]
    o = C.O(spark, SF_SMALL)
    got = {r["EmployeeID"]: r for r in pl.score_raw(o, bundle, "id").collect()}
    want = {r["id"]: r["p"] for r in ev["scores"].collect()}
    assert got.keys() == want.keys()
    for i, p in want.items():
        assert abs(got[i]["AttritionProbability"] - p) <= 5.1e-5
        assert got[i]["PredictedAttrition"] == ("Yes" if p >= ev["threshold"] else "No")
    rec = o.filter("WorkLifeBalance is not null").first().asDict()
    schema = ", ".join(f"{c} {t}" for c, t in o.dtypes)
    one = pl.score_record(spark, rec, schema, bundle, "id").collect()
    assert len(one) == 1 and one[0] == got[rec["id"]]


def test_explanations_add_up_to_the_fitted_logit(spark, trained):
    out, _, ev = trained
    bundle = pl.load_bundle(spark, out)
    o = C.O(spark, SF_SMALL)
    parts = pl.explain_raw(o.limit(50), o, bundle, "id", top_n=None).groupBy("id").agg(
        (F.max("base_value") + F.sum("shap_value")).alias("z")).collect()
    p = {r["id"]: r["p"] for r in ev["scores"].collect()}
    assert len(parts) == 50
    for r in parts:
        assert 1 / (1 + math.exp(-r["z"])) == pytest.approx(p[r["id"]], abs=1e-9)


def test_encoder_and_weights_are_fitted_inside_each_fold(spark):
    """A category and a mean that only the held-out fold has must not show in the fold's encoder."""
    rows = [(i, i % 2, "odd" if i < 10 else "even" if i % 2 else "third", 1000.0 if i < 10 else float(i), 0 if i < 10 else 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label int, kind string, x double, fold int")
    state, stages, data, n = ml._encoded(True, df.filter("fold <> 0"), ["kind"], ["x"], "label")
    assert state.nominal.categories == {"kind": ["even", "third"]} and n == 50
    assert state.scaler.moments["x"][0] == pytest.approx(sum(range(10, 60)) / 50)
    assert data.agg(F.sum("weight")).first()[0] == pytest.approx(50)


def test_null_policy_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "b", 4.0), (4, "a", float("nan"))], "id int, k string, x double")
    state = enc.fit_encoder(df, ["k"], ["x"], impute=True)
    got = {r["id"]: (r["k_b"], r["x"], r["x_missing"]) for r in enc.transform_features(df, state, keep=["id"]).collect()}
    assert got == {1: (0.0, 2.0, 0.0), 2: (0.0, 3.0, 1.0), 3: (1.0, 4.0, 0.0), 4: (0.0, 3.0, 1.0)}


def test_vector_encoder_for_many_categories(spark):
    df = spark.createDataFrame([(i, f"c{i % 700:03d}") for i in range(1400)] + [(-1, None)], "id int, k string")
    with pytest.raises(ValueError):
        enc.fit_one_hot(df, ["k"], max_categories=100)
    v = enc.vector_encoder(["k"]).fit(df).transform(df)
    assert v.count() == 1401 and v.first()["nominal_vector"].size >= 699


def test_split_and_folds_keep_null_labels(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 3 == 0).cast("int")))
    s = sp.stratified_split(df, "label", ["id"], small=40)
    sizes = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert sum(sizes.values()) == 1000 and sizes[None, "test"] == 20 and sizes[1, "test"] == 60 and sizes[0, "test"] == 120
    f = sp.stratified_folds(df, "label", ["id"], k=5, small=40)
    per = f.groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in per) == 1000
    assert all(max(c) - min(c) <= 1 for c in [[r["count"] for r in per if r["label"] == x] for x in (None, 0, 1)])
    tiny = sp.stratified_folds(spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, label int"), "label", ["id"], k=5).collect()
    assert sorted(r["fold"] for r in tiny) == [0, 1, 2]


def test_role_medians_state_round_trip(spark):
    from hrlens.sources import io
    state = fe.fit_feature_state(C.O(spark, SF_SMALL))
    path = tempfile.mkdtemp(prefix="hrlens-state-") + "/m"
    io.save_feature_state(state, path)
    back = io.load_feature_state(spark, path)
    assert back.n_roles == state.n_roles and back.medians.exceptAll(state.medians).count() == 0


def test_encoders_of_all_folds_from_one_pass(spark):
    """The same as one fit per fold, with gaps, a column that is empty outside a fold and a category of one fold only."""
    rows = [(i, "ab"[i % 2] if i % 7 else None, "only" if i % 3 == 1 else None, float(i * i) if i % 5 else None, float(i) if i % 3 == 0 else None, 4, i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, k string, l string, x double, z double, c int, fold int")
    got = enc.fit_encoders(df, ["k", "l"], ["x", "z", "c"], [0, 1, 2, None], scale=["x", "z", "c"])
    for f, pair in got.items():
        inside = df if f is None else df.filter(F.col("fold") != f)
        for state, scale in zip(pair, (None, ["x", "z", "c"])):
            want = enc.fit_encoder(inside, ["k", "l"], ["x", "z", "c"], scale=scale, impute=True)
            assert (state.nominal, state.passthrough, state.output_names()) == (want.nominal, want.passthrough, want.output_names())
            assert state.fill == pytest.approx(want.fill)
            for c in (want.scaler.moments if scale else ()):
                assert state.scaler.moments[c] == pytest.approx(want.scaler.moments[c])
    with pytest.raises(ValueError):
        enc.fit_encoders(df, ["k", "l"], ["x"], [None], max_categories=2)
