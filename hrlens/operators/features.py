"""Business feature engineering with fitted state.

``fit_feature_state`` learns the median income per role on training rows;
``apply_features`` adds the eight derived columns in one projection plus one
left lookup join.  The lookup table has one row per role; its size is counted
at fit time and it is broadcast only when that count is under
``broadcast_max_rows`` (otherwise a shuffle join, with AQE skew handling).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_lower, col, row_mean, safe_div
from ..session import cut_lineage
from .quantile import quantiles, value_counts
from .segments import SATISFACTION_COLUMNS

ENGINEERED = ["promotion_stagnation_ratio", "role_tenure_share", "manager_tenure_share",
              "income_vs_role_median", "compensation_per_experience", "avg_satisfaction_score",
              "burnout_risk_flag", "job_stability_index"]

#: base columns that each derived feature is computed from
INPUTS_OF = {
    "promotion_stagnation_ratio": ["YearsSinceLastPromotion", "YearsAtCompany"],
    "role_tenure_share": ["YearsInCurrentRole", "YearsAtCompany"],
    "manager_tenure_share": ["YearsWithCurrManager", "YearsAtCompany"],
    "income_vs_role_median": ["MonthlyIncome", "JobRole"],
    "compensation_per_experience": ["MonthlyIncome", "TotalWorkingYears"],
    "avg_satisfaction_score": list(SATISFACTION_COLUMNS),
    "burnout_risk_flag": ["OverTime", "WorkLifeBalance"],
    "job_stability_index": ["TotalWorkingYears", "NumCompaniesWorked"],
}

# Fixed values from the reference configuration.
BURNOUT_WLB_THRESHOLD = 2
CORRELATION_THRESHOLD = 0.92


@dataclass
class FeatureState:
    medians: DataFrame          # (role, role_median_income)
    n_roles: int
    role_col: str = "JobRole"
    income_col: str = "MonthlyIncome"


def fit_feature_state(train: DataFrame, role_col: str = "JobRole",
                      income_col: str = "MonthlyIncome") -> FeatureState:
    """A1: exact (interpolated) median income per non-null role, on training rows."""
    roles = train.filter(col(role_col).isNotNull())
    counts = value_counts(roles, [income_col], [role_col])
    q = quantiles(counts, [role_col], [0.5]).select(role_col, F.col("q")[0].alias("role_median_income"))
    med = cut_lineage(roles.select(role_col).distinct().join(q, role_col, "left"))
    return FeatureState(med, med.count(), role_col, income_col)


def apply_features(df: DataFrame, state: FeatureState | None,
                   satisfaction: Sequence[str] = SATISFACTION_COLUMNS,
                   wlb_threshold: int = BURNOUT_WLB_THRESHOLD,
                   broadcast_max_rows: int = 200_000, features: Sequence[str] = ENGINEERED) -> DataFrame:
    """The derived columns (null-preserving clips, null on a zero median).  ``features`` are
    those that are needed; without ``income_vs_role_median`` no state is needed either."""
    wanted = [f for f in ENGINEERED if f in features]
    income = state.income_col if state else "MonthlyIncome"
    yac = clip_lower("YearsAtCompany", 1)
    total = clip_lower("TotalWorkingYears", 1)
    ncos = clip_lower("NumCompaniesWorked", 1)
    joined = df
    if "income_vs_role_median" in wanted:
        lookup = F.broadcast(state.medians) if state.n_roles <= broadcast_max_rows else state.medians
        joined = df.join(lookup, state.role_col, "left")
    burnout = F.coalesce((col("OverTime") == "Yes") & (col("WorkLifeBalance") <= wlb_threshold),
                         F.lit(False)).cast("int")
    derived = {
        "promotion_stagnation_ratio": safe_div("YearsSinceLastPromotion", yac),
        "role_tenure_share": safe_div("YearsInCurrentRole", yac),
        "manager_tenure_share": safe_div("YearsWithCurrManager", yac),
        "income_vs_role_median": safe_div(income, "role_median_income"),
        "compensation_per_experience": safe_div(income, total),
        "avg_satisfaction_score": row_mean(list(satisfaction)),
        "burnout_risk_flag": burnout,
        "job_stability_index": safe_div("TotalWorkingYears", ncos),
    }
    return joined.withColumns({f: derived[f] for f in wanted}).drop("role_median_income").select(*df.columns, *wanted)


def with_engineered_features(train: DataFrame, df: DataFrame, **kw) -> DataFrame:
    """T16 convenience: fit on ``train``, apply to ``df``."""
    return apply_features(df, fit_feature_state(train), **kw)


def engineered_feature_catalog(spark) -> DataFrame:
    """Q16: name and formula of each derived feature (a small static table)."""
    rows = [
        ("promotion_stagnation_ratio", "YearsSinceLastPromotion / max(YearsAtCompany, 1)"),
        ("role_tenure_share", "YearsInCurrentRole / max(YearsAtCompany, 1)"),
        ("manager_tenure_share", "YearsWithCurrManager / max(YearsAtCompany, 1)"),
        ("income_vs_role_median", "MonthlyIncome / median MonthlyIncome of the JobRole (train rows)"),
        ("compensation_per_experience", "MonthlyIncome / max(TotalWorkingYears, 1)"),
        ("avg_satisfaction_score", "mean of the non-null satisfaction columns"),
        ("burnout_risk_flag", f"OverTime = 'Yes' and WorkLifeBalance <= {BURNOUT_WLB_THRESHOLD}"),
        ("job_stability_index", "TotalWorkingYears / max(NumCompaniesWorked, 1)"),
    ]
    return spark.createDataFrame(rows, "feature string, formula string")


def engineered_feature_report(df: DataFrame) -> DataFrame:
    """Q16: the catalog beside what the derived columns of ``df`` hold: values, nulls and their range, from
    one aggregate pass.  A derived column that ``df`` lacks has no figures."""
    held = [f for f in ENGINEERED if f in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(held):
        aggs += [F.count(f).alias(f"n{i}"), F.min(f).cast("double").alias(f"lo{i}"), F.max(f).cast("double").alias(f"hi{i}")]
    per = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("values"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
                             F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, f in enumerate(held)])
    if not held:
        per = per.cast("array<struct<feature:string,values:bigint,nulls:bigint,min:double,max:double>>")
    figures = df.agg(*aggs).select(F.explode(per).alias("p")).select("p.*")
    return engineered_feature_catalog(df.sparkSession).join(figures, "feature", "left")
