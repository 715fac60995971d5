"""Golden arithmetic from the reference's stored evaluation results:
confusion matrices must give the published metrics (4 dp), gaps their class."""
import pytest

from hrlens.operators import metrics as mt
from pyspark.sql import functions as F

# (TN, FP, FN, TP) → accuracy, precision, recall, F1, balanced accuracy, MCC
GOLDEN = {
    "logistic_regression": ((194, 53, 14, 33), (.7721, .3837, .7021, .4962, .7438, .3928)),
    "xgboost": ((232, 15, 32, 15), (.8401, .5000, .3191, .3896, .6292, .3129)),
    "random_forest": ((229, 18, 35, 12), (.8197, .4000, .2553, .3117, .5912, .2209)),
    "decision_tree": ((202, 45, 28, 19), (.7517, .2969, .4043, .3423, .6110, .1972)),
}


def test_confusion_to_metrics(spark):
    rows = [(m, *cm) for m, (cm, _) in GOLDEN.items()]
    cm = spark.createDataFrame(rows, "model string, tn long, fp long, fn long, tp long")
    got = {r["model"]: r for r in mt.metrics_from_confusion(cm).collect()}
    for m, (_, exp) in GOLDEN.items():
        r = got[m]
        vals = (r["accuracy"], r["precision"], r["recall"], r["f1"], r["balanced_accuracy"], r["mcc"])
        assert [round(v, 4) for v in vals] == pytest.approx(list(exp), abs=1e-4), m


def test_confusion_from_rows(spark):
    # rebuild score rows from the LR confusion matrix and recount through M1
    tn, fp, fn, tp = GOLDEN["logistic_regression"][0]
    rows = [("lr", 0, 0.1)] * tn + [("lr", 0, 0.9)] * fp + [("lr", 1, 0.1)] * fn + [("lr", 1, 0.9)] * tp
    df = spark.createDataFrame(rows, "model string, y int, p double")
    r = mt.confusion(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (tn, fp, fn, tp)


@pytest.mark.parametrize("gap,label", [(.0716, "Moderate Overfit"), (.1545, "Severe Overfit"),
                                       (.2352, "Severe Overfit"), (.0199, "Excellent"),
                                       (.02, "Minor Overfit"), (.05, "Moderate Overfit")])
def test_overfit_class(spark, gap, label):
    from hrlens.functions.exprs import overfit_class
    assert spark.range(1).select(overfit_class(F.lit(gap))).first()[0] == label


def test_split_quotas_match_published_sizes(spark):
    from hrlens.operators.split import split_quotas
    # 1,470 rows, 237 positives → 294 test rows with 47 positives (1,176 train)
    q = split_quotas(spark.createDataFrame([(0, 1233), (1, 237)], "cls int, n long"), 0.2)
    assert {r["cls"]: r["rank"] for r in q.collect()} == {0: 247, 1: 47}
