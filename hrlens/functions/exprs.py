"""Column-expression helpers shared by the operators.

All of these are built-in Spark expressions (whole-stage codegen, no Python
UDF).  Null semantics follow the pandas behaviour the reference relies on;
each helper notes the rule it implements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_d(x: float) -> Column:
    """A double literal (a bare ``0.5`` in SQL text would be a decimal)."""
    return F.lit(float(x)).cast("double")


def clip_lower(c: ColumnOrName, lower: float) -> Column:
    """``Series.clip(lower=...)``: null stays null (``greatest`` would not)."""
    c = col(c)
    return F.when(c < lower, F.lit(lower)).otherwise(c)


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Double division that yields null (not an ANSI error) on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def div0(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division with sklearn's ``zero_division=0`` rule."""
    return F.coalesce(safe_div(num, den), lit_d(0.0))


def row_mean(cols: Sequence[ColumnOrName]) -> Column:
    """Horizontal mean that skips nulls (pandas ``mean(axis=1)``); all-null → null."""
    total = sum((F.coalesce(col(c).cast("double"), lit_d(0.0)) for c in cols), lit_d(0.0))
    n = sum((F.when(col(c).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return safe_div(total, n)


def label01(target: ColumnOrName, positive: str = "Yes") -> Column:
    """Inline target encoding ``(t == positive).astype(int)``: null → 0."""
    return F.coalesce(col(target) == F.lit(positive), F.lit(False)).cast("int")


def is_missing(c: ColumnOrName, dtype: str) -> Column:
    """pandas ``isna``: null, and NaN for floating columns."""
    c = col(c)
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def band(c: ColumnOrName, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut(..., right=False)``: left-closed bins; outside the edges → null."""
    c = col(c)
    expr = None
    for lo, hi, name in zip(edges[:-1], edges[1:], labels):
        cond = (c >= lo) & (c < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(None).cast("string"))


def band_index(c: ColumnOrName, edges: Sequence[float]) -> Column:
    """Ordinal (0-based) of the left-closed bin, null outside the edges."""
    c = col(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (c >= lo) & (c < hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


# Fixed values that must equal the reference's (risk tiers, overfit classes).
RISK_TIERS = ((0.60, "High"), (0.40, "Elevated"), (0.25, "Moderate"), (0.0, "Low"))
OVERFIT_CLASSES = ((0.02, "Excellent"), (0.05, "Minor Overfit"), (0.10, "Moderate Overfit"))
OVERFIT_ELSE = "Severe Overfit"


def risk_tier(p: ColumnOrName) -> Column:
    """p ≥ .60 High, ≥ .40 Elevated, ≥ .25 Moderate, else Low; null stays null."""
    p = col(p)
    expr = None
    for cut, name in RISK_TIERS[:-1]:
        cond = p >= lit_d(cut)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.when(p.isNotNull(), F.lit(RISK_TIERS[-1][1]))


def confidence(p: ColumnOrName) -> Column:
    """Distance from 0.5, scaled to [0, 1]."""
    return F.abs(col(p) - lit_d(0.5)) * lit_d(2.0)


def overfit_class(gap: ColumnOrName) -> Column:
    """Class of an unrounded train-test gap; null stays null."""
    g = col(gap)
    expr = None
    for cut, name in OVERFIT_CLASSES:
        cond = g < lit_d(cut)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.when(g.isNotNull(), F.lit(OVERFIT_ELSE))


def display_name(c: ColumnOrName) -> Column:
    """``str.replace('_', ' ').str.title()`` for model names."""
    return F.initcap(F.translate(col(c), "_", " "))


def status_label(target: ColumnOrName, positive: str = "Yes", negative: str = "No") -> Column:
    """No → Stayed, Yes → Left, anything else → null (``Series.map`` miss)."""
    t = col(target)
    return F.when(t == positive, "Left").when(t == negative, "Stayed")


def r(c: ColumnOrName, digits: int = 6) -> Column:
    """Half-even rounding of a double (numpy / pandas ``round``)."""
    return F.bround(col(c).cast("double"), digits)


def score_label(c: ColumnOrName, low: str, high: str, levels: int = 4) -> Column:
    """1 → "1 — <low>", top level → "<levels> — <high>", others their number."""
    c = col(c)
    return (F.when(c == 1, F.lit(f"1 — {low}")).when(c == levels, F.lit(f"{levels} — {high}"))
             .when(c.isNotNull(), c.cast("string")))


def feature_tag(name: ColumnOrName, engineered: list[str]) -> Column:
    """T17: "Engineered" for derived feature names, else "Base"."""
    return F.when(col(name).isin(engineered), F.lit("Engineered")).otherwise(F.lit("Base"))
