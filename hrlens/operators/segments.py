"""Segment analytics: rates by group, bands, cross-tabs, group statistics, KPIs,
and the explorer filter.

Every operator is one aggregate plan (partial aggregation map-side, one
shuffle on the grouping keys).  Null grouping keys are dropped the way
pandas ``groupby`` drops them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import band, band_index, col, label01, lit_d, r
from .quantile import quantiles, value_counts

# Fixed values that must equal the reference's band definitions.
INCOME_EDGES = [0, 3000, 5000, 7500, 10000, 20000]
INCOME_LABELS = ["< $3k", "$3k–5k", "$5k–7.5k", "$7.5k–10k", "$10k+"]
AGE_EDGES = [18, 25, 30, 35, 40, 50, 61]
AGE_LABELS = ["18–24", "25–29", "30–34", "35–39", "40–49", "50–60"]
SATISFACTION_COLUMNS = ["JobSatisfaction", "EnvironmentSatisfaction",
                        "RelationshipSatisfaction", "WorkLifeBalance"]


def _rate_aggs(target: str, positive: str) -> list[Column]:
    return [
        F.count(col(target)).alias("employees"),
        F.bround(F.avg(label01(target, positive)) * lit_d(100.0), 2).alias("attrition_rate"),
    ]


def rate_by_segment(df: DataFrame, group: str, target: str = "Attrition",
                    positive: str = "Yes") -> DataFrame:
    """A2: employees (non-null target count) and attrition % (2 dp) per group, rate desc."""
    return (df.filter(col(group).isNotNull())
              .groupBy(group).agg(*_rate_aggs(target, positive))
              .orderBy(F.desc("attrition_rate"), F.asc(group)))


def rate_by_segments(df: DataFrame, groups: Sequence[str], target: str = "Attrition",
                     positive: str = "Yes") -> DataFrame:
    """A3: A2 for several keys in one job → (dimension, segment, employees, attrition_rate).

    The keys are stacked once (Expand) and aggregated with one shuffle, rather
    than one scan per key.
    """
    stacked = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(g).alias("dimension"), col(g).cast("string").alias("segment"))
            for g in groups])).alias("k"),
        label01(target, positive).alias("_y"), col(target).alias("_t"))
    return (stacked.filter(F.col("k.segment").isNotNull())
            .groupBy(F.col("k.dimension").alias("dimension"), F.col("k.segment").alias("segment"))
            .agg(F.count("_t").alias("employees"),
                 F.bround(F.avg("_y") * lit_d(100.0), 2).alias("attrition_rate"))
            .orderBy("dimension", F.desc("attrition_rate"), "segment"))


def category_rate(df: DataFrame, column: str, target: str = "Attrition",
                  positive: str = "Yes") -> DataFrame:
    """A4: unrounded attrition % per category, desc (dashboard form)."""
    return (df.filter(col(column).isNotNull()).groupBy(column)
              .agg((F.avg(label01(target, positive)) * lit_d(100.0)).alias("AttritionRate"))
              .orderBy(F.desc("AttritionRate"), column))


def rate_by_band(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str],
                 band_col: str, target: str = "Attrition", positive: str = "Yes") -> DataFrame:
    """Left-closed banding (``pd.cut(right=False)``), then A2; out-of-range rows drop."""
    banded = df.select(band(column, edges, labels).alias(band_col),
                       band_index(column, edges).alias("band_order"),
                       col(target).alias(target))
    return (banded.filter(F.col(band_col).isNotNull())
            .groupBy(band_col, "band_order").agg(*_rate_aggs(target, positive))
            .orderBy(F.desc("attrition_rate"), "band_order"))


def rate_by_income_band(df: DataFrame, column: str = "MonthlyIncome", **kw) -> DataFrame:
    return rate_by_band(df, column, INCOME_EDGES, INCOME_LABELS, "IncomeBand", **kw)


def rate_by_age_band(df: DataFrame, column: str = "Age", **kw) -> DataFrame:
    return rate_by_band(df, column, AGE_EDGES, AGE_LABELS, "AgeBand", **kw)


def class_balance(df: DataFrame, target: str = "Attrition",
                  classes: Sequence[str] = ("No", "Yes")) -> DataFrame:
    """Count and % (2 dp) per class in a fixed order; an absent class is kept with 0.

    The fixed class list is a tiny literal table; the right join keeps absent
    classes.  Percent is over non-null targets (``value_counts(normalize)``).
    """
    spark = df.sparkSession
    order = spark.createDataFrame([(c, i) for i, c in enumerate(classes)],
                                  f"{target} string, class_order int")
    counts = df.filter(col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_n"))
    return (order.join(counts, target, "left").crossJoin(total)
            .select(target, "class_order",
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    F.coalesce(F.bround(F.try_divide(F.col("count") * lit_d(100.0), F.col("_n")), 2),
                               lit_d(0.0)).alias("percent"))
            .orderBy("class_order"))


def crosstab(df: DataFrame, key: str, target: str = "Attrition", positive: str = "Yes") -> DataFrame:
    """Stayed / left counts per key value."""
    y = label01(target, positive)
    return (df.filter(col(key).isNotNull()).groupBy(key)
              .agg(F.count_if(y == 0).alias("stayed"), F.count_if(y == 1).alias("left"))
              .orderBy(key))


def group_medians(df: DataFrame, columns: Sequence[str] = ("Age", "MonthlyIncome"),
                  target: str = "Attrition", positive: str = "Yes") -> DataFrame:
    """Exact (interpolated) medians of ``columns`` per 0/1 label."""
    y = label01(target, positive)
    counts = value_counts(df.select(y.alias("label"), *[col(c) for c in columns]), list(columns), ["label"])
    q = quantiles(counts, ["label", "column"], [0.5])
    return (q.groupBy("label").agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"median_{c}") for c in columns])
            .orderBy("label"))


def histogram_density(df: DataFrame, column: str, target: str = "Attrition",
                      bins: int = 20) -> DataFrame:
    """``bins`` equal-width bins over each class's own range, density-normalised, empty bins
    included.

    Matplotlib's rule: the last bin is closed; a constant class uses the range [v-0.5, v+0.5].  The
    rows are first reduced to value counts per class, so no row of the table is joined.
    """
    counts = value_counts(df.filter(col(target).isNotNull()).select(col(target).alias("cls"), col(column)), [column], ["cls"])
    bounds = counts.groupBy("cls").agg(F.min("value").alias("lo0"), F.max("value").alias("hi0"), F.sum("n").alias("n"))
    flat = F.col("lo0") == F.col("hi0")
    bounds = bounds.select(
        "cls", F.col("n").alias("total"),
        F.when(flat, F.col("lo0") - lit_d(0.5)).otherwise(F.col("lo0")).alias("lo"),
        F.when(flat, F.col("hi0") + lit_d(0.5)).otherwise(F.col("hi0")).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / lit_d(bins)
    bounds = bounds.select("cls", "total", "lo", w.alias("w"))
    own = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    filled = counts.join(bounds, "cls").groupBy("cls", own.alias("bin")).agg(F.sum("n").alias("count"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (every.join(filled, ["cls", "bin"], "left")
            .withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
            .select(F.col("cls").alias(target), "bin",
                    r(F.col("lo") + F.col("bin") * F.col("w")).alias("bin_left"),
                    r(F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_right"),
                    "count", r(F.col("count") / (F.col("total") * F.col("w"))).alias("density"))
            .orderBy(target, "bin"))


def _boxes(df: DataFrame, column: str, target: str, positive: str, negative: str, whis: float) -> DataFrame:
    """Value counts per status with the status's quartiles and fences."""
    status = F.when(col(target) == positive, "Left").when(col(target) == negative, "Stayed")
    counts = value_counts(df.select(status.alias("Status"), col(column)).filter(F.col("Status").isNotNull()), [column], ["Status"])
    q = quantiles(counts, ["Status"], [0.25, 0.5, 0.75]).select(
        "Status", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.select("*", (F.col("q1") - lit_d(whis) * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                 (F.col("q3") + lit_d(whis) * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    return counts.join(q, "Status").withColumn("inside", (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence")))


def box_stats(df: DataFrame, column: str, target: str = "Attrition",
              positive: str = "Yes", negative: str = "No", whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme points inside the 1.5·IQR fences), flier count per status,
    all from the value counts per status."""
    x, inside = F.col("value"), F.col("inside")
    return (_boxes(df, column, target, positive, negative, whis).groupBy("Status", "q1", "median", "q3")
            .agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
                 F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_fliers"))
            .orderBy("Status"))


def box_fliers(df: DataFrame, column: str, target: str = "Attrition",
               positive: str = "Yes", negative: str = "No", whis: float = 1.5) -> DataFrame:
    """The points outside the fences, ``Status, value, n`` (rows with that value)."""
    return _boxes(df, column, target, positive, negative, whis).filter("not inside").select("Status", "value", "n")


def mean_score_by_dimension(df: DataFrame, target: str = "Attrition",
                            columns: Sequence[str] = SATISFACTION_COLUMNS) -> DataFrame:
    """Melt the score columns, mean per (target, dimension); nulls skipped."""
    long = df.filter(col(target).isNotNull()).unpivot(
        [target], list(columns), "Dimension", "Score")
    return (long.groupBy(target, "Dimension").agg(r(F.avg("Score")).alias("Score"))
            .orderBy(target, "Dimension"))


def kpi_row(df: DataFrame, target: str = "Attrition", positive: str = "Yes",
            negative: str = "No", overtime: str = "OverTime", tenure: str = "YearsAtCompany",
            department: str = "Department", role: str = "JobRole") -> DataFrame:
    """The dashboard KPIs (one row).

    The table is reduced to one row of sums per (department, role), so the distinct counts see those
    few rows and the full rows are never expanded.
    """
    t, y = col(target), label01(target, positive)
    nulls = sum((F.sum(col(c).isNull().cast("long")) for c in df.columns), F.lit(0).cast("long"))
    ot = col(overtime) == "Yes"
    part = df.groupBy(col(department).alias("d"), col(role).alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t == positive).alias("left"), F.count_if(t == negative).alias("stayed"),
        F.sum(y).alias("y"), F.count_if(ot).alias("ot"), F.sum(F.when(ot, y)).alias("oty"),
        F.sum(col(tenure)).alias("tenure"), F.count(col(tenure)).alias("tn"), nulls.alias("nulls"))
    share = lambda a, b: r(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")) * lit_d(100.0))
    zero = F.lit(0).cast("long")
    return part.agg(
        F.coalesce(F.sum("n"), zero).alias("headcount"), F.coalesce(F.sum("left"), zero).alias("leavers"),
        F.coalesce(F.sum("stayed"), zero).alias("stayers"), share("y", "n").alias("attrition_pct"),
        share("oty", "ot").alias("overtime_attrition_pct"),
        r(F.try_divide(F.sum("tenure").cast("double"), F.sum("tn").cast("double"))).alias("mean_tenure"),
        F.count_distinct("d").alias("departments"), F.count_distinct("r").alias("roles"),
        F.coalesce(F.sum("nulls"), zero).alias("total_nulls"), F.lit(len(df.columns)).alias("columns"))


def headline_figures(df: DataFrame, departments: tuple[str, str], target: str = "Attrition",
                     positive: str = "Yes") -> DataFrame:
    """The figures behind the headline statements, long form (figure, value).

    ``departments``: the two whose rates are compared.  Rates are percentages.
    """
    y = label01(target, positive).cast("double")

    def rate(cond: Column | None = None) -> Column:
        return F.avg(y if cond is None else F.when(cond, y)) * lit_d(100.0)

    first, second = (rate(col("Department") == d) for d in departments)
    ot, no_ot = rate(col("OverTime") == "Yes"), rate(col("OverTime") == "No")
    figures = {
        "overall_rate": rate(), "leavers": F.sum(y), "employees": F.count(F.lit(1)).cast("double"),
        "first_department_rate": first, "second_department_rate": second, "department_gap_pp": first - second,
        "overtime_rate": ot, "no_overtime_rate": no_ot, "overtime_ratio": F.try_divide(ot, no_ot),
        "lowest_income_band_rate": rate(band("MonthlyIncome", INCOME_EDGES, INCOME_LABELS) == INCOME_LABELS[0]),
        "poor_work_life_rate": rate(col("WorkLifeBalance") == 1), "low_satisfaction_rate": rate(col("JobSatisfaction") == 1),
        "youngest_band_rate": rate(band("Age", AGE_EDGES, AGE_LABELS) == AGE_LABELS[0])}
    wide = df.agg(*[r(v).alias(k) for k, v in figures.items()]).unpivot([], list(figures), "figure", "value")
    med = group_medians(df, ["Age"], target, positive)
    name = F.when(F.col("label") == 1, "median_leaver_age").otherwise("median_stayer_age")
    return wide.unionByName(med.select(name.alias("figure"), r("median_Age").alias("value")))


def feature_sanity_rates(featured: DataFrame, target: str = "Attrition",
                         positive: str = "Yes") -> DataFrame:
    """Attrition % by burnout flag, low/high satisfaction and below/above role median."""
    y = label01(target, positive).cast("double")

    def rate(cond: Column) -> Column:
        return r(F.avg(F.when(cond, y)) * lit_d(100.0))

    s, m, b = F.col("avg_satisfaction_score"), F.col("income_vs_role_median"), F.col("burnout_risk_flag")
    return featured.agg(
        rate(b == 0).alias("no_burnout_pct"), rate(b == 1).alias("burnout_pct"),
        rate(s <= 2).alias("low_satisfaction_pct"), rate(s >= 3.5).alias("high_satisfaction_pct"),
        rate(m < 1.0).alias("below_role_median_pct"), rate(m >= 1.0).alias("at_or_above_role_median_pct"))


def headline_extremes(df: DataFrame, group: str = "JobRole", target: str = "Attrition",
                      positive: str = "Yes") -> DataFrame:
    """Highest- and lowest-rate segment (ties → smallest key) from the A2 table.

    The A2 table has one row per segment, so the final one-row aggregate is cheap.
    """
    s = rate_by_segment(df, group, target, positive)
    top = F.min(F.struct((-F.col("attrition_rate")).alias("k"), F.col(group).alias("seg")))
    bottom = F.min(F.struct(F.col("attrition_rate").alias("k"), F.col(group).alias("seg")))
    return s.agg(top.alias("top"), bottom.alias("bottom")).select(
        F.col("top.seg").alias("highest_segment"), (-F.col("top.k")).alias("highest_rate"),
        F.col("bottom.seg").alias("lowest_segment"), F.col("bottom.k").alias("lowest_rate"))


def tier_counts(pred: DataFrame, tier: str = "RiskTier") -> DataFrame:
    """Rows per risk tier."""
    return pred.groupBy(tier).agg(F.count(F.lit(1)).alias("count")).orderBy(tier)


def explorer_filter(df: DataFrame, departments: Sequence[str] | None = None,
                    attrition: Sequence[str] | None = None, overtime: Sequence[str] | None = None,
                    age_range: tuple[int, int] | None = None,
                    income_range: tuple[int, int] | None = None, search: str = "",
                    id_col: str = "EmployeeNumber", regex: bool = True,
                    display: Sequence[str] | None = None) -> DataFrame:
    """AND of ``isin`` lists (None = no constraint, [] = no rows), inclusive ranges,
    id-substring search (regex like pandas ``str.contains`` or literal), display projection.
    """
    cond = F.lit(True)
    for c, values in (("Department", departments), ("Attrition", attrition), ("OverTime", overtime)):
        if values is not None:
            cond = cond & (col(c).isin(list(values)) if values else F.lit(False))
    if age_range is not None:
        cond = cond & col("Age").between(*age_range)
    if income_range is not None:
        cond = cond & col("MonthlyIncome").between(*income_range)
    s = search.strip()
    if s:
        idc = col(id_col).cast("string")
        cond = cond & (idc.rlike(s) if regex else idc.contains(s))
    out = df.filter(F.coalesce(cond, F.lit(False)))
    return out.select(*display) if display else out


def explorer_bounds(df: DataFrame, columns: Sequence[str] = ("Age", "MonthlyIncome")) -> DataFrame:
    """the default range of each numeric filter (column, low, high)."""
    wide = df.agg(*[f(col(c)).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high")) for c in columns])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def category_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """distinct non-blank values per column, long form (column, value) sorted.

    Kept long rather than one collected list per column, so no group is ever
    gathered into a single value.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns
    ])).alias("k")).select("k.column", "k.value")
    return (long.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
            .distinct().orderBy("column", "value"))
