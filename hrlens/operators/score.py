"""Batch scoring, decoration and per-row linear explanations.

Scoring is shuffle-free: a projection for a linear model (weights as
literals), or ``PipelineModel.transform`` for any Spark ML model.  The
explanation is computed for ALL rows at once with the linear-SHAP formula
φ_j = w_j·(x_j − mean(x_j)), base = b + Σ_j w_j·mean(x_j), so
base + Σφ = the row's logit.  The means are one aggregate over the whole
background table (the training rows); a sample is the caller's choice.

A row whose probability is null (a feature is null) has no prediction, tier
or confidence, and a null contribution has no direction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, confidence, lit_d, risk_tier

DEFAULT_THRESHOLD = 0.5
DEFAULT_TOP_N = 12


@dataclass
class LinearModel:
    """Intercept and per-feature weights in model space (e.g. from LogisticRegressionModel)."""
    intercept: float
    weights: dict[str, float]

    @staticmethod
    def from_spark(model, feature_names: Sequence[str]) -> "LinearModel":
        coef = model.coefficients.toArray().tolist()
        return LinearModel(float(model.intercept), dict(zip(feature_names, coef)))

    def logit(self) -> Column:
        z = lit_d(self.intercept)
        for f, w in self.weights.items():
            z = z + lit_d(w) * col(f).cast("double")
        return z


def sigmoid(z: Column) -> Column:
    return lit_d(1.0) / (lit_d(1.0) + F.exp(-z))


def predict_linear(df: DataFrame, model: LinearModel, id_col: str,
                   threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """I5 for a linear model: (id, probability, prediction 0/1)."""
    p = sigmoid(model.logit())
    return df.select(col(id_col).alias(id_col), p.alias("probability"),
                     (p >= lit_d(threshold)).cast("int").alias("prediction"))


def predict_spark_model(df: DataFrame, model, id_col: str | None,
                        threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """I5 for any fitted ``pyspark.ml`` model with a ``probability`` vector.

    Without an id column, ids come from ``monotonically_increasing_id`` (unique,
    not consecutive: the reference numbers rows 1..n).
    """
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    ident = col(id_col) if id_col and id_col in df.columns else F.monotonically_increasing_id()
    return out.select(ident.alias(id_col or "id"), p.alias("probability"),
                      (p >= lit_d(threshold)).cast("int").alias("prediction"))


def prediction_frame(pred: DataFrame, id_col: str) -> DataFrame:
    """EmployeeID, probability (4 dp), Yes/No, risk tier, confidence (4 dp)."""
    p = F.col("probability")
    return pred.select(
        F.col(id_col).alias("EmployeeID"), F.bround(p, 4).alias("AttritionProbability"),
        F.when(F.col("prediction") == 1, "Yes").when(F.col("prediction") == 0, "No").alias("PredictedAttrition"),
        risk_tier(p).alias("RiskTier"), F.bround(confidence(p), 4).alias("ConfidenceScore"))


def background_means(background: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Mean of each model-space feature over all rows of ``background``."""
    row = background.agg(*[F.avg(col(f).cast("double")).alias(f) for f in features]).first()
    return {f: (row[f] if row[f] is not None else 0.0) for f in features}


def linear_contributions(df: DataFrame, model: LinearModel, id_col: str,
                         background: DataFrame | None = None, top_n: int | None = DEFAULT_TOP_N,
                         means: dict[str, float] | None = None) -> DataFrame:
    """Per id, the top-``top_n`` features by |φ| (ties by name):
    (id, rank, feature, shap_value, feature_value, direction, base_value).

    The top-k is taken inside each row (sort of a k-feature array), so there
    is no window or shuffle.
    """
    feats = list(model.weights)
    if means is None:
        means = background_means(df if background is None else background, feats)
    base = model.intercept
    for f in feats:                      # left to right, like SQL's a + b + c
        base = base + model.weights[f] * means[f]
    items = F.array(*[
        F.struct(F.coalesce(-F.abs(lit_d(model.weights[f]) * (col(f).cast("double") - lit_d(means[f]))),
                            F.lit(float("inf"))).alias("k"),
                 F.lit(f).alias("feature"),
                 (lit_d(model.weights[f]) * (col(f).cast("double") - lit_d(means[f]))).alias("shap_value"),
                 col(f).cast("double").alias("feature_value"))
        for f in feats])
    ranked = F.array_sort(items)
    if top_n:
        ranked = F.slice(ranked, 1, top_n)
    return (df.select(col(id_col).alias(id_col), F.posexplode(ranked).alias("pos", "c"))
              .select(id_col, (F.col("pos") + 1).alias("rank"), "c.feature", "c.shap_value",
                      "c.feature_value",
                      F.when(F.col("c.shap_value") >= 0, "Increases risk")
                       .when(F.col("c.shap_value") < 0, "Decreases risk").alias("direction"),
                      lit_d(base).alias("base_value")))
