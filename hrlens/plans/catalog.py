"""Registered queries: each name maps to a Spark plan over the driver's tables
and (where the result is SQL-expressible) a DuckDB oracle string.

The Spark side always goes through the library operators; the oracle is
written independently in plain SQL against the same proxy views.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import segments as seg
from ..sources.proxies import employee_view, score_view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, score: bool = False):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, score=score)
        return fn
    return deco


Y = "CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END"


def O(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employee_view(spark, sf_dir)


def C(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_view(spark, sf_dir)


# ---------------------------------------------------------------- segments (A*, F*)

@register("rate_by_segment", f"""
SELECT Department, count(Attrition) AS employees,
       round_even(avg({Y}) * 100e0, 2) AS attrition_rate
FROM o WHERE Department IS NOT NULL GROUP BY Department""")
def q_rate_by_segment(spark, d):
    return seg.rate_by_segment(O(spark, d), "Department")


@register("rate_by_segments_all", f"""
SELECT dimension, segment, count(Attrition) AS employees,
       round_even(avg({Y}) * 100e0, 2) AS attrition_rate
FROM (SELECT 'Department' AS dimension, Department AS segment, Attrition FROM o
      UNION ALL SELECT 'JobRole', JobRole, Attrition FROM o
      UNION ALL SELECT 'OverTime', OverTime, Attrition FROM o
      UNION ALL SELECT 'JobSatisfaction', CAST(JobSatisfaction AS VARCHAR), Attrition FROM o
      UNION ALL SELECT 'WorkLifeBalance', CAST(WorkLifeBalance AS VARCHAR), Attrition FROM o) s
WHERE segment IS NOT NULL GROUP BY dimension, segment""")
def q_rate_by_segments_all(spark, d):
    return seg.rate_by_segments(O(spark, d), ["Department", "JobRole", "OverTime",
                                              "JobSatisfaction", "WorkLifeBalance"])


@register("category_rate", f"""
SELECT Region, avg({Y}) * 100e0 AS AttritionRate FROM o WHERE Region IS NOT NULL GROUP BY Region""")
def q_category_rate(spark, d):
    return seg.category_rate(O(spark, d), "Region")


def _band_sql(column: str, edges, labels, name: str) -> str:
    whens = " ".join(f"WHEN {column} >= {lo} AND {column} < {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    order = " ".join(f"WHEN {column} >= {lo} AND {column} < {hi} THEN {i}"
                     for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    return f"""
SELECT {name}, band_order, count(Attrition) AS employees,
       round_even(avg({Y}) * 100e0, 2) AS attrition_rate
FROM (SELECT CASE {whens} END AS {name}, CASE {order} END AS band_order, Attrition FROM o) b
WHERE {name} IS NOT NULL GROUP BY {name}, band_order"""


@register("rate_by_income_band", _band_sql("MonthlyIncome", seg.INCOME_EDGES, seg.INCOME_LABELS, "IncomeBand"))
def q_rate_by_income_band(spark, d):
    return seg.rate_by_income_band(O(spark, d))


@register("rate_by_age_band", _band_sql("Age", seg.AGE_EDGES, seg.AGE_LABELS, "AgeBand"))
def q_rate_by_age_band(spark, d):
    return seg.rate_by_age_band(O(spark, d))


@register("class_balance", """
SELECT k.Attrition, k.class_order, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
       coalesce(round_even(c.cnt * 100e0 / t.n, 2), 0e0) AS percent
FROM (VALUES ('No', 0), ('Yes', 1)) k(Attrition, class_order)
LEFT JOIN (SELECT Attrition, count(*) AS cnt FROM o WHERE Attrition IS NOT NULL GROUP BY Attrition) c
  ON k.Attrition = c.Attrition
CROSS JOIN (SELECT count(*) AS n FROM o WHERE Attrition IS NOT NULL) t""")
def q_class_balance(spark, d):
    return seg.class_balance(O(spark, d))


@register("crosstab", f"""
SELECT OverTime, count(*) FILTER (WHERE {Y} = 0) AS stayed, count(*) FILTER (WHERE {Y} = 1) AS "left"
FROM o WHERE OverTime IS NOT NULL GROUP BY OverTime""")
def q_crosstab(spark, d):
    return seg.crosstab(O(spark, d), "OverTime")


@register("group_medians", f"""
SELECT {Y} AS label, median(CAST(Age AS DOUBLE)) AS median_Age,
       median(CAST(MonthlyIncome AS DOUBLE)) AS median_MonthlyIncome
FROM o GROUP BY 1""")
def q_group_medians(spark, d):
    return seg.group_medians(O(spark, d))


@register("histogram_density", """
WITH data AS (SELECT Attrition AS cls, CAST(CASE WHEN id % 1000 = 7 THEN MonthlyIncome * 50 ELSE MonthlyIncome END AS DOUBLE) AS x FROM o
              WHERE Attrition IS NOT NULL AND MonthlyIncome IS NOT NULL),
b0 AS (SELECT cls, min(x) AS lo0, max(x) AS hi0, count(*) AS n FROM data GROUP BY cls),
b AS (SELECT cls, n, CASE WHEN lo0 = hi0 THEN lo0 - 0.5e0 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5e0 ELSE hi0 END AS hi FROM b0),
binned AS (SELECT d.cls, n, lo, (hi - lo) / 20e0 AS w,
                  CAST(least(floor((x - lo) / ((hi - lo) / 20e0)), 19) AS INTEGER) AS bin
           FROM data d JOIN b ON d.cls = b.cls)
SELECT cls AS Attrition, bin, round_even(lo + bin * w, 6) AS bin_left,
       round_even(lo + (bin + 1) * w, 6) AS bin_right, coalesce(c, 0) AS count,
       round_even(coalesce(c, 0) / (n * w), 6) AS density
FROM (SELECT cls, n, lo, (hi - lo) / 20e0 AS w, CAST(k AS INTEGER) AS bin FROM b CROSS JOIN range(20) r(k)) e
LEFT JOIN (SELECT cls, bin, count(*) AS c FROM binned GROUP BY cls, bin) f USING (cls, bin)""")
def q_histogram_density(spark, d):
    """Few incomes far up leave bins empty; they are part of the result."""
    o = O(spark, d).withColumn("MonthlyIncome", F.when(F.col("id") % 1000 == 7, F.col("MonthlyIncome") * 50).otherwise(F.col("MonthlyIncome")))
    return seg.histogram_density(o, "MonthlyIncome")


@register("box_stats", """
WITH data AS (SELECT CASE WHEN Attrition = 'Yes' THEN 'Left' WHEN Attrition = 'No' THEN 'Stayed' END AS Status,
                     CAST(Age AS DOUBLE) AS x FROM o),
d AS (SELECT * FROM data WHERE Status IS NOT NULL AND x IS NOT NULL),
q AS (SELECT Status, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM d GROUP BY Status),
f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo_fence, q3 + 1.5e0 * (q3 - q1) AS hi_fence FROM q)
SELECT d.Status, q1, median, q3,
       min(CASE WHEN x >= lo_fence AND x <= hi_fence THEN x END) AS whisker_low,
       max(CASE WHEN x >= lo_fence AND x <= hi_fence THEN x END) AS whisker_high,
       count(*) FILTER (WHERE NOT (x >= lo_fence AND x <= hi_fence)) AS n_fliers
FROM d JOIN f ON d.Status = f.Status GROUP BY d.Status, q1, median, q3""")
def q_box_stats(spark, d):
    return seg.box_stats(O(spark, d), "Age")


@register("box_fliers", """
WITH data AS (SELECT CASE WHEN Attrition = 'Yes' THEN 'Left' WHEN Attrition = 'No' THEN 'Stayed' END AS Status,
                     MonthlyIncome::DOUBLE * MonthlyIncome::DOUBLE * MonthlyIncome::DOUBLE * MonthlyIncome::DOUBLE AS x FROM o),
d AS (SELECT * FROM data WHERE Status IS NOT NULL AND x IS NOT NULL),
q AS (SELECT Status, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM d GROUP BY Status),
f AS (SELECT Status, q1 - 1.5e0 * (q3 - q1) AS lo_fence, q3 + 1.5e0 * (q3 - q1) AS hi_fence FROM q)
SELECT d.Status, x AS value, count(*) AS n FROM d JOIN f ON d.Status = f.Status
WHERE NOT (x >= lo_fence AND x <= hi_fence) GROUP BY d.Status, x""")
def q_box_fliers(spark, d):
    """The income's fourth power has a long tail, so that there are points outside the fences."""
    m = F.col("MonthlyIncome").cast("double")
    return seg.box_fliers(O(spark, d).withColumn("x", m * m * m * m), "x")


@register("mean_score_unpivot", """
SELECT Attrition, Dimension, round_even(avg(Score), 6) AS Score FROM (
  SELECT Attrition, 'JobSatisfaction' AS Dimension, JobSatisfaction AS Score FROM o
  UNION ALL SELECT Attrition, 'EnvironmentSatisfaction', EnvironmentSatisfaction FROM o
  UNION ALL SELECT Attrition, 'RelationshipSatisfaction', RelationshipSatisfaction FROM o
  UNION ALL SELECT Attrition, 'WorkLifeBalance', WorkLifeBalance FROM o) m
WHERE Attrition IS NOT NULL GROUP BY Attrition, Dimension""")
def q_mean_score_unpivot(spark, d):
    return seg.mean_score_by_dimension(O(spark, d))


_O_COLS = ["id", "Attrition", "Department", "JobRole", "Region", "OverTime", "Age", "MonthlyIncome",
           "YearsAtCompany", "TotalWorkingYears", "YearsInCurrentRole", "YearsWithCurrManager",
           "YearsSinceLastPromotion", "NumCompaniesWorked", "JobSatisfaction",
           "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance",
           "StandardHours", "n_lines", "qty", "max_discount"]


@register("kpi_row", f"""
SELECT count(*) AS headcount, count(*) FILTER (WHERE Attrition = 'Yes') AS leavers,
       count(*) FILTER (WHERE Attrition = 'No') AS stayers,
       round_even(avg({Y}) * 100e0, 6) AS attrition_pct,
       round_even(avg(CASE WHEN OverTime = 'Yes' THEN {Y} END) * 100e0, 6) AS overtime_attrition_pct,
       round_even(avg(YearsAtCompany), 6) AS mean_tenure,
       count(DISTINCT Department) AS departments, count(DISTINCT JobRole) AS roles,
       CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in _O_COLS)} AS BIGINT) AS total_nulls,
       {len(_O_COLS)} AS columns
FROM o""")
def q_kpi_row(spark, d):
    return seg.kpi_row(O(spark, d))


@register("headline_extremes", f"""
WITH s AS (SELECT JobRole, round_even(avg({Y}) * 100e0, 2) AS rate FROM o
           WHERE JobRole IS NOT NULL GROUP BY JobRole)
SELECT (SELECT JobRole FROM s ORDER BY rate DESC, JobRole LIMIT 1) AS highest_segment,
       (SELECT max(rate) FROM s) AS highest_rate,
       (SELECT JobRole FROM s ORDER BY rate ASC, JobRole LIMIT 1) AS lowest_segment,
       (SELECT min(rate) FROM s) AS lowest_rate""")
def q_headline_extremes(spark, d):
    return seg.headline_extremes(O(spark, d))


@register("headline_figures", f"""
WITH r AS (SELECT avg({Y}) * 100e0 AS overall_rate, sum({Y})::DOUBLE AS leavers, count(*)::DOUBLE AS employees,
  avg(CASE WHEN Department = 'BUILDING' THEN {Y} END) * 100e0 AS first_department_rate,
  avg(CASE WHEN Department = 'MACHINERY' THEN {Y} END) * 100e0 AS second_department_rate,
  avg(CASE WHEN OverTime = 'Yes' THEN {Y} END) * 100e0 AS overtime_rate, avg(CASE WHEN OverTime = 'No' THEN {Y} END) * 100e0 AS no_overtime_rate,
  avg(CASE WHEN MonthlyIncome >= 0 AND MonthlyIncome < 3000 THEN {Y} END) * 100e0 AS lowest_income_band_rate,
  avg(CASE WHEN WorkLifeBalance = 1 THEN {Y} END) * 100e0 AS poor_work_life_rate, avg(CASE WHEN JobSatisfaction = 1 THEN {Y} END) * 100e0 AS low_satisfaction_rate,
  avg(CASE WHEN Age >= 18 AND Age < 25 THEN {Y} END) * 100e0 AS youngest_band_rate,
  median(CASE WHEN {Y} = 1 THEN Age END) AS median_leaver_age, median(CASE WHEN {Y} = 0 THEN Age END) AS median_stayer_age FROM o),
f AS (SELECT *, first_department_rate - second_department_rate AS department_gap_pp, overtime_rate / no_overtime_rate AS overtime_ratio FROM r)
SELECT figure, round_even(v, 6) AS value FROM (UNPIVOT f ON COLUMNS(*) INTO NAME figure VALUE v) u""")
def q_headline_figures(spark, d):
    return seg.headline_figures(O(spark, d), ("BUILDING", "MACHINERY"))


@register("explorer_bounds", """
SELECT 'Age' AS "column", min(Age)::DOUBLE AS low, max(Age)::DOUBLE AS high FROM o
UNION ALL SELECT 'MonthlyIncome', min(MonthlyIncome)::DOUBLE, max(MonthlyIncome)::DOUBLE FROM o""")
def q_explorer_bounds(spark, d):
    return seg.explorer_bounds(O(spark, d))


@register("explorer_filter", """
SELECT id, Age, Department, JobRole, MonthlyIncome, OverTime, JobSatisfaction, WorkLifeBalance, Attrition
FROM o
WHERE Department IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND Attrition IN ('Yes', 'No')
  AND OverTime IN ('Yes') AND Age BETWEEN 25 AND 50 AND MonthlyIncome BETWEEN 1000 AND 15000
  AND regexp_matches(CAST(id AS VARCHAR), '7')""")
def q_explorer_filter(spark, d):
    return seg.explorer_filter(
        O(spark, d), departments=["BUILDING", "MACHINERY", "HOUSEHOLD"], attrition=["Yes", "No"],
        overtime=["Yes"], age_range=(25, 50), income_range=(1000, 15000), search=" 7 ", id_col="id",
        display=["id", "Age", "Department", "JobRole", "MonthlyIncome", "OverTime",
                 "JobSatisfaction", "WorkLifeBalance", "Attrition"])


@register("category_options", """
SELECT DISTINCT "column", value FROM (
  SELECT 'Department' AS "column", Department AS value FROM o
  UNION ALL SELECT 'JobRole', JobRole FROM o
  UNION ALL SELECT 'OverTime', OverTime FROM o
  UNION ALL SELECT 'Region', Region FROM o) t
WHERE value IS NOT NULL AND trim(value) <> ''""")
def q_category_options(spark, d):
    return seg.category_options(O(spark, d), ["Department", "JobRole", "OverTime", "Region"])


# ---------------------------------------------------------------- profiling (Q*) and cleaning

from pyspark.sql import functions as F  # noqa: E402

from ..operators import clean as cl  # noqa: E402
from ..operators import profile as pf  # noqa: E402
from ..operators import sketches as sk  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources.proxies import DUP_SQL, bad_label_view, duplicates_view  # noqa: E402

O_SCHEMA = [("id", "bigint"), ("Attrition", "string"), ("Department", "string"),
            ("JobRole", "string"), ("Region", "string"), ("OverTime", "string"), ("Age", "int"),
            ("MonthlyIncome", "int"), ("YearsAtCompany", "int"), ("TotalWorkingYears", "int"),
            ("YearsInCurrentRole", "int"), ("YearsWithCurrManager", "int"),
            ("YearsSinceLastPromotion", "int"), ("NumCompaniesWorked", "int"),
            ("JobSatisfaction", "int"), ("EnvironmentSatisfaction", "int"),
            ("RelationshipSatisfaction", "int"), ("WorkLifeBalance", "int"),
            ("StandardHours", "int"), ("n_lines", "bigint"), ("qty", "double"),
            ("max_discount", "double")]
O_NUM = [c for c, t in O_SCHEMA if t != "string" and c != "id"]
O_STR = [c for c, t in O_SCHEMA if t == "string"]


def _miss(c: str, t: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if t == "double" else f"{c} IS NULL"


_MISSING_SUM = " + ".join(f"count(*) FILTER (WHERE {_miss(c, t)})" for c, t in O_SCHEMA)


@register("dataset_summary", f"""
WITH d AS ({DUP_SQL}),
dd AS (SELECT * EXCLUDE (src) FROM d),
t AS (SELECT count(*) AS rows, CAST({_MISSING_SUM} AS BIGINT) AS missing_values,
             CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dd)) AS BIGINT) AS duplicate_rows FROM dd)
""" + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, (SELECT count(*) FROM dd WHERE {_miss(c, t)}) AS missing,
rows, {len(O_SCHEMA)} AS columns, missing_values, duplicate_rows FROM t""" for i, (c, t) in enumerate(O_SCHEMA)))
def q_dataset_summary(spark, d):
    return pf.dataset_summary(duplicates_view(O(spark, d)).drop("src"))


@register("schema_overview", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null_count, "
    f"count(DISTINCT {c}) AS unique_values FROM o" for i, (c, t) in enumerate(O_SCHEMA)))
def q_schema_overview(spark, d):
    return pf.schema_overview(O(spark, d))


@register("missing_report", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_miss(c, t)}) AS missing FROM o"
    for c, t in O_SCHEMA) + ") m WHERE missing > 0")
def q_missing_report(spark, d):
    return pf.missing_report(O(spark, d))


@register("duplicate_report", f"""
WITH d AS ({DUP_SQL}), dd AS (SELECT * EXCLUDE (src) FROM d)
SELECT CAST((SELECT count(*) FROM dd) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dd)) AS BIGINT) AS duplicate_rows,
       CAST((SELECT count(*) - count(DISTINCT id) - max(CASE WHEN id IS NULL THEN 1 ELSE 0 END) FROM dd) AS BIGINT) AS duplicate_ids""")
def q_duplicate_report(spark, d):
    return pf.duplicate_report(duplicates_view(O(spark, d)).drop("src"), "id")


@register("dedup_keep_first", f"""
WITH d AS ({DUP_SQL})
SELECT * EXCLUDE (src, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY src) AS rn FROM d) t WHERE rn = 1""")
def q_dedup_keep_first(spark, d):
    return cl.handle_duplicates(duplicates_view(O(spark, d)), "id", ["src"])


def _const_text(c: str, t: str) -> str:
    return f"CAST(min(CAST({c} AS DECIMAL(38, 6))) AS VARCHAR)" if t == "double" else f"CAST(min({c}) AS VARCHAR)"


@register("constant_columns", "WITH k AS (SELECT *, 0.125e0 AS rate FROM o) SELECT \"column\", value FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_const_text(c, t)} AS value, count(DISTINCT {c}) AS nd FROM k"
    for c, t in [*O_SCHEMA, ("rate", "double")]) + ") x WHERE nd = 1")
def q_constant_columns(spark, d):
    return pf.constant_columns(O(spark, d).withColumn("rate", F.lit(0.125)))


IQR_COLS = ["Age", "MonthlyIncome", "YearsAtCompany", "TotalWorkingYears", "NumCompaniesWorked",
            "qty", "n_lines"]


@register("iqr_outliers", "WITH " + ",\n".join(
    f"""s_{c} AS (SELECT '{c}' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3,
        count(DISTINCT {c}) AS unique_values, count(*) AS n FROM o)"""
    for c in IQR_COLS) + "\n" + " UNION ALL ".join(
    f"""SELECT "column", min, max, q1, q3, round_even(q1 - 1.5e0 * (q3 - q1), 6) AS iqr_lower,
        round_even(q3 + 1.5e0 * (q3 - q1), 6) AS iqr_upper,
        (SELECT count(*) FROM o WHERE {c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) AS outlier_count,
        round_even((SELECT count(*) FROM o WHERE {c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) * 100e0 / n, 2) AS outlier_pct,
        unique_values FROM s_{c}""" for c in IQR_COLS))
def q_iqr_outliers(spark, d):
    return pf.iqr_outliers(O(spark, d), IQR_COLS + ["NotAColumn"])


@register("describe_numeric", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round_even(avg({c}::DOUBLE), 6) AS mean,
        round_even(stddev_samp({c}::DOUBLE), 6) AS std, min({c})::DOUBLE AS min,
        quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50,
        quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS max FROM o""" for c in O_NUM))
def q_describe_numeric(spark, d):
    return pf.describe_numeric(O(spark, d), O_NUM)


@register("category_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count FROM o WHERE {c} IS NOT NULL GROUP BY {c}"""
    for c in O_STR))
def q_category_counts(spark, d):
    return pf.category_counts(O(spark, d), O_STR)


_CARDINALITY_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values FROM o""" for c in O_STR)


@register("cardinality_ranking", _CARDINALITY_SQL)
def q_cardinality_ranking(spark, d):
    return pf.cardinality_ranking(O(spark, d), O_STR)


def _sketches(spark, d) -> str:
    """Sketches of view O by region, stored in two steps: the second one meets only parts that are new."""
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    sk.update(O(spark, d).filter("Region < 'B'"), "Region", path)
    sk.update(O(spark, d), "Region", path)
    return path


@register("schema_overview_sketched")
def q_schema_overview_sketched(spark, d):
    """Q2 in the cheap mode (rows-only: distinct counts are estimates, tested against the exact ones)."""
    return sk.schema_overview(spark, _sketches(spark, d))


@register("cardinality_ranking_sketched", _CARDINALITY_SQL)
def q_cardinality_ranking_sketched(spark, d):
    """Q12 in the cheap mode; sketches of so few values count them exactly."""
    return sk.cardinality_ranking(spark, _sketches(spark, d), O_STR)


@register("column_groups_sketched")
def q_column_groups_sketched(spark, d):
    """Q15 in the cheap mode (rows-only, as above)."""
    return sk.column_groups(spark, _sketches(spark, d), GROUPS_O)


@register("bad_labels", """
WITH b AS (SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN 'Maybe' ELSE Attrition END AS Attrition) FROM o)
SELECT Attrition, count(*) AS rows FROM b
WHERE Attrition IS NULL OR Attrition NOT IN ('Yes', 'No') GROUP BY Attrition""")
def q_bad_labels(spark, d):
    return cl.unexpected_labels(bad_label_view(O(spark, d)))


@register("encode_target", """
SELECT id, CAST(CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END AS INTEGER) AS Attrition_label
FROM o""")
def q_encode_target(spark, d):
    return cl.encode_target(O(spark, d)).select("id", "Attrition_label")


# ---------------------------------------------------------------- encoding and features (T*, A1)

from pyspark.sql import functions as F  # noqa: E402

from ..functions.exprs import r as _round  # noqa: E402
from ..operators import encode as enc  # noqa: E402
from ..operators import features as fe  # noqa: E402
from ..operators import split as sp  # noqa: E402

H1 = "(id * 7919) % 10007"
H2 = "(id * 104729) % 10009"


def _lab(o):
    return o.select("id", F.when(F.col("Attrition") == "Yes", 1).otherwise(0).alias("label"))


# Quotas in SQL: test total ceil(0.2 n); train allocated by floor + largest remainder (ties by label).
def _split_sql(src: str, h: str) -> str:
    return f"""
src AS ({src}),
cnt AS (SELECT label, count(*) AS n_c FROM src GROUP BY label),
tot AS (SELECT sum(n_c) AS n, sum(n_c) - ceil(0.2e0 * sum(n_c)) AS n_train FROM cnt),
alloc AS (SELECT label, n_c, n_c * n_train / n::DOUBLE AS cont, floor(n_c * n_train / n::DOUBLE) AS fl, n_train
          FROM cnt CROSS JOIN tot),
need AS (SELECT n_train - sum(fl) AS k FROM alloc GROUP BY n_train),
ranked_rem AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, label) AS rr FROM alloc),
quota AS (SELECT label, n_c - (fl + CASE WHEN rr <= (SELECT k FROM need) THEN 1 ELSE 0 END) AS q FROM ranked_rem),
rk AS (SELECT src.*, row_number() OVER (PARTITION BY label ORDER BY {h}, id) AS r FROM src),
sp AS (SELECT rk.*, CASE WHEN r <= q THEN 'test' ELSE 'train' END AS split FROM rk JOIN quota USING (label))"""


_LAB_SQL = f"SELECT id, {Y} AS label FROM o"


#: fitted state is learned on the rows of the X1 train split (CTE ``tr`` in the oracles)
FIT_SQL = f"""{_split_sql(_LAB_SQL, H1)},
tr AS (SELECT o.* FROM o JOIN sp ON o.id = sp.id WHERE sp.split = 'train')"""
NOMINAL_O = ["Department", "JobRole", "OverTime", "Region"]
SCALE_O = ["Age", "MonthlyIncome", "TotalWorkingYears", "YearsAtCompany", "NumCompaniesWorked"]
PASS_O = ["JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance"]


def O_train(o):
    lab = o.withColumn("label", F.when(F.col("Attrition") == "Yes", 1).otherwise(0))
    s = sp.stratified_split(lab, "label", ["id"], h=F.expr(H1), hash_range=10007)
    return s.filter(F.col("split") == "train").drop("split", "label")


# categories as observed on the fit rows (the oracle states them; Spark learns them)
_CATS = {"Department": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
         "JobRole": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
         "OverTime": ["No", "Yes"],
         "Region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}
_ONEHOT_SQL = ", ".join(f"CAST(coalesce({c} = '{v}', false) AS DOUBLE) AS \"{c}_{v}\""
                        for c, vals in _CATS.items() for v in vals[1:])


@register("one_hot", f"SELECT id, {_ONEHOT_SQL} FROM o")
def q_one_hot(spark, d):
    o = O(spark, d)
    st = enc.fit_one_hot(O_train(o), NOMINAL_O)
    return o.select("id", *enc.one_hot_columns(st))


_MOM = ", ".join(f"avg({c}::DOUBLE) AS m_{c}, stddev_pop({c}::DOUBLE) AS s_{c}" for c in SCALE_O)
_SCALED = ", ".join(
    f"round_even(({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1e0 ELSE s_{c} END, 6) AS {c}"
    for c in SCALE_O)


@register("standardise", f"""
WITH {FIT_SQL}, mom AS (SELECT {_MOM} FROM tr)
SELECT id, {_SCALED} FROM o CROSS JOIN mom""")
def q_standardise(spark, d):
    o = O(spark, d)
    st = enc.fit_scaler(O_train(o), SCALE_O)
    return o.select("id", *enc.scaled_columns(st)).select(
        "id", *[_round(c).alias(c) for c in SCALE_O])


@register("transform_features", f"""
WITH {FIT_SQL}, mom AS (SELECT {_MOM} FROM tr)
SELECT id, Attrition, {_ONEHOT_SQL}, {_SCALED},
       {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PASS_O)}
FROM o CROSS JOIN mom""")
def q_transform_features(spark, d):
    o = O(spark, d)
    st = enc.fit_encoder(O_train(o), NOMINAL_O, SCALE_O + PASS_O, scale=SCALE_O)
    out = enc.transform_features(o, st, keep=["id", "Attrition"])
    return out.select(*[_round(c).alias(c) if c in SCALE_O else F.col(f"`{c}`")
                        for c in out.columns])


@register("role_median_state", f"""
WITH {FIT_SQL}
SELECT JobRole, median(MonthlyIncome::DOUBLE) AS role_median_income
FROM tr WHERE JobRole IS NOT NULL GROUP BY JobRole""")
def q_role_median_state(spark, d):
    return fe.fit_feature_state(O_train(O(spark, d))).medians


_FE_SQL = f"""
WITH {FIT_SQL}, med AS (SELECT JobRole, median(MonthlyIncome::DOUBLE) AS med FROM tr
             WHERE JobRole IS NOT NULL GROUP BY JobRole),
x AS (SELECT o.*, med.med,
        CASE WHEN YearsAtCompany < 1 THEN 1 ELSE YearsAtCompany END AS yac,
        CASE WHEN TotalWorkingYears < 1 THEN 1 ELSE TotalWorkingYears END AS twy,
        CASE WHEN NumCompaniesWorked < 1 THEN 1 ELSE NumCompaniesWorked END AS ncw
      FROM o LEFT JOIN med ON o.JobRole = med.JobRole)
SELECT id,
  round_even(YearsSinceLastPromotion / nullif(yac, 0)::DOUBLE, 6) AS promotion_stagnation_ratio,
  round_even(YearsInCurrentRole / nullif(yac, 0)::DOUBLE, 6) AS role_tenure_share,
  round_even(YearsWithCurrManager / nullif(yac, 0)::DOUBLE, 6) AS manager_tenure_share,
  round_even(MonthlyIncome / nullif(med, 0), 6) AS income_vs_role_median,
  round_even(MonthlyIncome / nullif(twy, 0)::DOUBLE, 6) AS compensation_per_experience,
  round_even((coalesce(JobSatisfaction, 0) + coalesce(EnvironmentSatisfaction, 0)
    + coalesce(RelationshipSatisfaction, 0) + coalesce(WorkLifeBalance, 0))::DOUBLE
    / nullif((JobSatisfaction IS NOT NULL)::INT + (EnvironmentSatisfaction IS NOT NULL)::INT
    + (RelationshipSatisfaction IS NOT NULL)::INT + (WorkLifeBalance IS NOT NULL)::INT, 0), 6) AS avg_satisfaction_score,
  CAST(coalesce(OverTime = 'Yes' AND WorkLifeBalance <= 2, false) AS INTEGER) AS burnout_risk_flag,
  round_even(TotalWorkingYears / nullif(ncw, 0)::DOUBLE, 6) AS job_stability_index
FROM x"""


@register("engineered_features", _FE_SQL)
def q_engineered_features(spark, d):
    o = O(spark, d)
    out = fe.apply_features(o, fe.fit_feature_state(O_train(o)))
    return out.select("id", *[F.col(c) if c == "burnout_risk_flag" else _round(c).alias(c)
                              for c in fe.ENGINEERED])


# ---------------------------------------------------------------- evaluation metrics (M*) on view C

from ..operators import metrics as mt  # noqa: E402


def _score(name, sql):
    return register(name, sql, score=True)


_CM_SQL = """SELECT model, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
  count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn,
  count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, avg((p - y) * (p - y)) AS brier FROM c GROUP BY model"""

# Mann-Whitney form with average ranks: an independent check of the running-sum AUC.
_AUC_SQL = """SELECT model, (sum(CASE WHEN y = 1 THEN rk END) - P * (P + 1) / 2e0) / (P * N)::DOUBLE AS roc_auc
  FROM (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2e0 AS rk,
               sum(y) OVER (PARTITION BY model) AS P, sum(1 - y) OVER (PARTITION BY model) AS N FROM c) t
  GROUP BY model, P, N"""

_AP_SQL = """SELECT model, sum(pos * tp / (tp + fp)::DOUBLE) / max(P) AS pr_auc FROM (
    SELECT model, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS P
    FROM (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY model, p) d
    WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
  GROUP BY model"""

_MET_SQL = f"""cm AS ({_CM_SQL}),
m AS (SELECT model, tn, fp, fn, tp, brier,
  (tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
  (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0))
    / nullif((tp + fn > 0)::INT + (tn + fp > 0)::INT, 0) AS balanced_accuracy,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0e0
       ELSE (tp * tn - fp * fn)::DOUBLE / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc
  FROM cm),
auc AS ({_AUC_SQL}), ap AS ({_AP_SQL})"""

_MET6 = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc"]


@_score("confusion", f"SELECT model, tn, fp, fn, tp, round_even(brier, 6) AS brier FROM ({_CM_SQL}) x")
def q_confusion(spark, d):
    return mt.confusion(C(spark, d)).withColumn("brier", _round("brier"))


@_score("scalar_metrics", f"""WITH {_MET_SQL}
SELECT m.model, tn, fp, fn, tp, {', '.join(f'round_even({c}, 6) AS {c}' for c in _MET6)},
       round_even(brier, 6) AS brier_score, round_even(roc_auc, 6) AS roc_auc, round_even(pr_auc, 6) AS pr_auc
FROM m JOIN auc ON m.model = auc.model JOIN ap ON m.model = ap.model""")
def q_scalar_metrics(spark, d):
    m = mt.scalar_metrics(C(spark, d))
    return m.select("model", "tn", "fp", "fn", "tp",
                    *[_round(c).alias(c) for c in _MET6 + ["brier_score", "roc_auc", "pr_auc"]])


@_score("roc_auc", f"SELECT model, round_even(roc_auc, 9) AS roc_auc FROM ({_AUC_SQL}) x")
def q_roc_auc(spark, d):
    return mt.roc_auc(C(spark, d)).select("model", _round("roc_auc", 9).alias("roc_auc"))


@_score("avg_precision", f"SELECT model, round_even(pr_auc, 9) AS pr_auc FROM ({_AP_SQL}) x")
def q_avg_precision(spark, d):
    return mt.average_precision(C(spark, d)).select("model", _round("pr_auc", 9).alias("pr_auc"))


_CUM_SQL = """cum AS (SELECT model, p AS s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
  FROM (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY model, p) d
  WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@_score("roc_points", f"""WITH {_CUM_SQL}
SELECT model, round_even(s, 6) AS threshold, round_even(fp / nullif(N, 0)::DOUBLE, 6) AS fpr,
       round_even(tp / nullif(P, 0)::DOUBLE, 6) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0e0, 0e0 FROM c""")
def q_roc_points(spark, d):
    pts = mt.roc_points(C(spark, d))
    return pts.select("model", _round("threshold").alias("threshold"), _round("fpr").alias("fpr"),
                      _round("tpr").alias("tpr"))


@_score("roc_vertices", f"""WITH {_CUM_SQL},
seq AS (SELECT *, row_number() OVER w AS k, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM (
  SELECT model, s, tp, fp, P, N, tp - coalesce(lag(tp) OVER v, 0) AS pos, fp - coalesce(lag(fp) OVER v, 0) AS neg
  FROM cum WINDOW v AS (PARTITION BY model ORDER BY s DESC)) x WINDOW w AS (PARTITION BY model ORDER BY s DESC))
SELECT model, round_even(s, 6) AS threshold, round_even(fp / nullif(N, 0)::DOUBLE, 6) AS fpr,
       round_even(tp / nullif(P, 0)::DOUBLE, 6) AS tpr FROM seq WHERE k = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0e0, 0e0 FROM c""")
def q_roc_vertices(spark, d):
    pts = mt.roc_vertices(C(spark, d))
    return pts.select("model", _round("threshold").alias("threshold"), _round("fpr").alias("fpr"), _round("tpr").alias("tpr"))


@_score("pr_points", f"""WITH {_CUM_SQL}
SELECT model, round_even(s, 6) AS threshold, round_even(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
       round_even(coalesce(tp / nullif(P, 0)::DOUBLE, 1), 6) AS recall FROM cum
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1e0, 0e0 FROM c""")
def q_pr_points(spark, d):
    pts = mt.pr_points(C(spark, d))
    return pts.select("model", _round("threshold").alias("threshold"),
                      _round("precision").alias("precision"), _round("recall").alias("recall"))


@_score("calibration", """
SELECT model, bin, count(*) AS n, round_even(avg(y::DOUBLE), 6) AS fraction_positive,
       round_even(avg(p), 6) AS mean_predicted
FROM (SELECT model, y, p, (p > 1 * 0.1e0)::INT + (p > 2 * 0.1e0)::INT + (p > 3 * 0.1e0)::INT
        + (p > 4 * 0.1e0)::INT + (p > 5 * 0.1e0)::INT + (p > 6 * 0.1e0)::INT + (p > 7 * 0.1e0)::INT
        + (p > 8 * 0.1e0)::INT + (p > 9 * 0.1e0)::INT AS bin FROM c) t
GROUP BY model, bin""")
def q_calibration(spark, d):
    cal = mt.calibration(C(spark, d))
    return cal.select("model", "bin", "n", _round("fraction_positive").alias("fraction_positive"),
                      _round("mean_predicted").alias("mean_predicted"))


def _opt_sql(method: str) -> str:
    score = ("coalesce(2 * tp / nullif(pp + P, 0)::DOUBLE, 0)" if method == "f1" else
             "tp / greatest(P, 1)::DOUBLE + (N - (pp - tp)) / greatest(N, 1)::DOUBLE - 1")
    return f"""WITH cand AS (
  SELECT DISTINCT model, least(greatest(round_even(p * 10000e0, 0), 100e0), 9900e0) / 10000e0 AS t FROM c
  UNION SELECT DISTINCT model, 0.05e0 FROM c UNION SELECT DISTINCT model, 0.95e0 FROM c),
tot AS (SELECT model, sum(y) AS P, sum(1 - y) AS N FROM c GROUP BY model),
ev AS (SELECT cand.model, t, count(c.p) AS pp, coalesce(sum(c.y), 0) AS tp
       FROM cand LEFT JOIN c ON c.model = cand.model AND c.p >= cand.t GROUP BY cand.model, t),
sc AS (SELECT ev.model, t, coalesce(2 * tp / nullif(pp + P, 0)::DOUBLE, 0) AS f1,
         coalesce(tp / nullif(pp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(P, 0)::DOUBLE, 0) AS recall,
         {score} AS score
       FROM ev JOIN tot ON ev.model = tot.model)
SELECT model, t AS threshold, round_even(f1, 6) AS f1, round_even(precision, 6) AS precision,
       round_even(recall, 6) AS recall, round_even(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, t) AS rn FROM sc) x WHERE rn = 1"""


def _opt_q(method):
    def q(spark, d):
        o = mt.optimal_threshold(C(spark, d), method=method)
        return o.select("model", "threshold", *[_round(c).alias(c) for c in
                                                ("f1", "precision", "recall", "score")])
    return q


_score("optimal_threshold_f1", _opt_sql("f1"))(_opt_q("f1"))
_score("optimal_threshold_youden", _opt_sql("youden"))(_opt_q("youden"))


@_score("threshold_table", f"""
WITH th AS (SELECT k / 100e0 AS threshold FROM range(10, 91, 5) t(k)),
cm AS (SELECT model, threshold, count(*) FILTER (WHERE y = 0 AND p < threshold) AS tn,
  count(*) FILTER (WHERE y = 0 AND p >= threshold) AS fp, count(*) FILTER (WHERE y = 1 AND p < threshold) AS fn,
  count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp FROM c CROSS JOIN th GROUP BY model, threshold)
SELECT model, threshold, round_even(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
  round_even(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
  round_even((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0))
    / nullif((tp + fn > 0)::INT + (tn + fp > 0)::INT, 0), 6) AS balanced_accuracy
FROM cm""")
def q_threshold_table(spark, d):
    t = mt.threshold_table(C(spark, d))
    return t.select("model", "threshold", *[_round(c).alias(c) for c in
                                            ("precision", "recall", "f1", "balanced_accuracy")])


def _split_c(spark, d):
    c = C(spark, d)
    return c.filter(F.col("id") % 5 != 0), c.filter(F.col("id") % 5 == 0)


def _f1_sql(src: str) -> str:
    return (f"SELECT model, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM (SELECT model, "
            f"count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, "
            f"count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp FROM {src} GROUP BY model) z")


_OVERFIT_SQL = f"""
c_tr AS (SELECT * FROM c WHERE id % 5 <> 0), c_te AS (SELECT * FROM c WHERE id % 5 = 0),
tr AS ({_AUC_SQL.replace('FROM c)', 'FROM c_tr)')}), trf AS ({_f1_sql('c_tr')}),
te AS ({_AUC_SQL.replace('FROM c)', 'FROM c_te)')}), tef AS ({_f1_sql('c_te')}),
g AS (SELECT tr.model, tr.roc_auc AS train_roc_auc, te.roc_auc AS test_roc_auc, tr.roc_auc - te.roc_auc AS roc_auc_gap,
             trf.f1 AS train_f1, tef.f1 AS test_f1
      FROM tr JOIN te ON tr.model = te.model JOIN trf ON tr.model = trf.model JOIN tef ON tr.model = tef.model)"""
_OVERFIT_CLASS = ("CASE WHEN roc_auc_gap < 0.02e0 THEN 'Excellent' WHEN roc_auc_gap < 0.05e0 THEN 'Minor Overfit' "
                  "WHEN roc_auc_gap < 0.10e0 THEN 'Moderate Overfit' ELSE 'Severe Overfit' END")


@_score("overfit_report", f"""WITH {_OVERFIT_SQL}
SELECT model, {', '.join(f'round_even({c}, 4) AS {c}' for c in ['train_roc_auc', 'test_roc_auc', 'roc_auc_gap', 'train_f1', 'test_f1'])},
       {_OVERFIT_CLASS} AS overfit_class FROM g""")
def q_overfit_report(spark, d):
    tr, te = _split_c(spark, d)
    return mt.overfit_report(tr, te)


def _null_scores(spark, d):
    p = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("p"))
    return C(spark, d).withColumn("p", p)


@_score("metrics_with_null_scores", f"""WITH {_MET_SQL.replace('FROM c ', 'FROM cn ').replace('FROM c)', 'FROM cn)')
                                              .replace('cm AS (', 'cn AS (SELECT * FROM c WHERE id % 7 > 1), cm AS (', 1)}
SELECT m.model, tn, fp, fn, tp, round_even(brier, 6) AS brier_score, round_even(roc_auc, 6) AS roc_auc, round_even(pr_auc, 6) AS pr_auc
FROM m JOIN auc ON m.model = auc.model JOIN ap ON m.model = ap.model""")
def q_metrics_with_null_scores(spark, d):
    """Null and NaN scores are left out of every metric alike."""
    m = mt.scalar_metrics(_null_scores(spark, d))
    return m.select("model", "tn", "fp", "fn", "tp", *[_round(c).alias(c) for c in ("brier_score", "roc_auc", "pr_auc")])


@_score("metrics_comparison", f"""WITH {_MET_SQL}
SELECT m.model, {', '.join(f'round_even({c}, 4) AS {c}' for c in ['accuracy', 'precision', 'recall', 'f1'])},
  round_even(roc_auc, 4) AS roc_auc, round_even(pr_auc, 4) AS pr_auc,
  round_even(balanced_accuracy, 4) AS balanced_accuracy, round_even(mcc, 4) AS mcc
FROM m JOIN auc ON m.model = auc.model JOIN ap ON m.model = ap.model""")
def q_metrics_comparison(spark, d):
    return mt.metrics_comparison(C(spark, d))


@_score("best_model", f"""WITH {_MET_SQL}, {_OVERFIT_SQL},
j AS (SELECT m.model, auc.roc_auc, m.f1, m.recall, coalesce(g.roc_auc_gap, 0e0) AS roc_auc_gap
      FROM m JOIN auc ON m.model = auc.model LEFT JOIN g ON m.model = g.model),
w AS (SELECT * FROM j ORDER BY roc_auc DESC, f1 DESC, recall DESC, roc_auc_gap ASC, model DESC LIMIT 1),
s AS (SELECT model, round_even(roc_auc, 4) AS roc_auc, round_even(f1, 4) AS f1, round_even(recall, 4) AS recall,
             round_even(roc_auc_gap, 4) AS roc_auc_gap, f1 AS f1_raw, recall AS recall_raw FROM w)
SELECT model, roc_auc, f1, recall, roc_auc_gap,
  printf('%s selected: highest test ROC-AUC (%.4f); F1 %.4f%s; recall %.4f%s; train-test ROC-AUC gap %.4f.',
    model, roc_auc, f1, CASE WHEN f1_raw >= (SELECT max(f1) FROM j) THEN ' (best)' ELSE '' END,
    recall, CASE WHEN recall_raw >= (SELECT max(recall) FROM j) THEN ' (highest)' ELSE '' END, roc_auc_gap) AS rationale
FROM s""")
def q_best_model(spark, d):
    tr, te = _split_c(spark, d)
    return mt.best_model(mt.scalar_metrics(C(spark, d)), mt.overfit_report(tr, te, digits=None))


# ---------------------------------------------------------------- correlation

from ..operators import correlation as corr  # noqa: E402

CORR_COLS = ["Age", "MonthlyIncome", "YearsAtCompany", "TotalWorkingYears", "YearsInCurrentRole",
             "YearsWithCurrManager", "YearsSinceLastPromotion", "NumCompaniesWorked",
             "JobSatisfaction", "EnvironmentSatisfaction", "RelationshipSatisfaction",
             "WorkLifeBalance", "n_lines", "qty", "max_discount"]


def _nan_null(e: str) -> str:
    return f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END"


@register("corr_with_label_top12", f"""
SELECT feature, round_even(r, 6) AS r FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, {_nan_null(f'corr({c}::DOUBLE, ({Y})::DOUBLE)')} AS r FROM o" for c in CORR_COLS)}
) t ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 12""")
def q_corr_with_label_top12(spark, d):
    out = corr.correlation_with_label(O(spark, d), CORR_COLS)
    return out.select("feature", _round("r").alias("r"))


@register("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {i} AS ia, {j} AS ib, round_even({_nan_null(f'corr({a}::DOUBLE, {b}::DOUBLE)')}, 6) AS r FROM o"
    for i, a in enumerate(CORR_COLS) for j, b in enumerate(CORR_COLS) if i < j))
def q_corr_matrix(spark, d):
    return corr.correlation_pairs(O(spark, d), CORR_COLS).withColumn("r", _round("r"))


RED_COLS = [*CORR_COLS, "YearsToRetirement", "QtyKnown"]


def _more_numbers(o):
    """O with a column that runs against Age (r = -1) and one with NaN entries."""
    return o.withColumn("YearsToRetirement", 65 - F.col("Age")).withColumn(
        "QtyKnown", F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("qty") + F.col("id") % 3))


@register("redundant_pairs", """WITH k AS (SELECT *, 65 - Age AS YearsToRetirement,
  CASE WHEN id % 9 = 0 THEN NULL ELSE qty + id % 3 END AS QtyKnown FROM o)
SELECT feature_a, feature_b, correlation, ia, ib FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round_even(abs(corr({a}::DOUBLE, {b}::DOUBLE)), 4) AS correlation, "
    f"{i} AS ia, {j} AS ib, corr({a}::DOUBLE, {b}::DOUBLE) AS r0 FROM k"
    for i, a in enumerate(RED_COLS) for j, b in enumerate(RED_COLS) if i < j)
    + ") t WHERE abs(r0) >= 0.92 AND NOT isnan(r0)")
def q_redundant_pairs(spark, d):
    return corr.redundant_pairs(_more_numbers(O(spark, d)), RED_COLS)


_WEIGHED = RED_COLS[:-1]  # the last feature has no importance and weighs 0


@register("redundancy_decisions", """SELECT * FROM (WITH RECURSIVE k AS (SELECT *, 65 - Age AS YearsToRetirement,
  CASE WHEN id % 9 = 0 THEN NULL ELSE qty + id % 3 END AS QtyKnown FROM o),
t AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}::DOUBLE, {b}::DOUBLE)) AS r, {i} AS ia, {j} AS ib FROM k"
    for i, a in enumerate(RED_COLS) for j, b in enumerate(RED_COLS) if i < j) + """),
w AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS f, count(DISTINCT {c})::DOUBLE AS w FROM k" for c in _WEIGHED) + """),
p AS (SELECT row_number() OVER (ORDER BY ia, ib) AS n, a, b, round_even(r, 4) AS r, coalesce(x.w, 0e0) AS wa, coalesce(y.w, 0e0) AS wb
      FROM t LEFT JOIN w x ON x.f = a LEFT JOIN w y ON y.f = b WHERE r >= 0.02 AND NOT isnan(r)),
fold AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS gone UNION ALL
  SELECT p.n, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) OR wa = wb THEN gone
                   WHEN wa < wb THEN list_append(gone, a) ELSE list_append(gone, b) END
  FROM fold JOIN p ON p.n = fold.n + 1),
d AS (SELECT CASE WHEN wa < wb THEN a ELSE b END AS dropped_feature, CASE WHEN wa < wb THEN b ELSE a END AS kept_feature,
        r AS correlation, least(wa, wb) AS dropped_importance, greatest(wa, wb) AS kept_importance
      FROM p JOIN fold ON fold.n = p.n - 1 WHERE wa <> wb AND NOT list_contains(gone, a) AND NOT list_contains(gone, b))
SELECT *, printf('|r| %.4f with %s; importance %.6f < %.6f', correlation, kept_feature, dropped_importance, kept_importance) AS reason FROM d) x""")
def q_redundancy_decisions(spark, d):
    """Which feature of a correlated pair goes; distinct values stand for the importance."""
    o = _more_numbers(O(spark, d))
    weights = o.agg(*[F.count_distinct(c).cast("double").alias(c) for c in _WEIGHED]).unpivot([], _WEIGHED, "feature", "importance")
    return corr.resolve_redundancy(corr.redundant_pairs(o, RED_COLS, 0.02), weights)


# ---------------------------------------------------------------- splits (X*) and class weights

@register("stratified_split_sizes", f"""WITH {_split_sql(_LAB_SQL, H1)}
SELECT id, label, split FROM sp""")
def q_stratified_split_sizes(spark, d):
    """The membership of every row."""
    return sp.stratified_split(_lab(O(spark, d)), "label", ["id"], h=F.expr(H1), hash_range=10007, small=500)


@register("validation_split_sizes", f"""WITH {_split_sql(_LAB_SQL, H1)},
{_split_sql("SELECT id, label FROM sp WHERE split = 'train'", H2).replace('src AS', 'src2 AS', 1)
  .replace('FROM src', 'FROM src2').replace('cnt', 'cnt2').replace('tot', 'tot2').replace('alloc', 'alloc2')
  .replace('need', 'need2').replace('ranked_rem', 'rr2').replace('quota', 'quota2')
  .replace('rk AS', 'rk2 AS').replace('FROM rk ', 'FROM rk2 ').replace('sp AS (SELECT rk.*', 'sp2 AS (SELECT rk2.*')
  .replace('src.*', 'src2.*')}
SELECT id, label, split FROM sp2""")
def q_validation_split_sizes(spark, d):
    """The membership of every train row in the validation carve-out."""
    s = sp.stratified_split(_lab(O(spark, d)), "label", ["id"], h=F.expr(H1), hash_range=10007)
    tr = s.filter(F.col("split") == "train").drop("split")
    return sp.stratified_split(tr, "label", ["id"], h=F.expr(H2), hash_range=10009)


_NULL_LAB_SQL = f"SELECT id, CASE WHEN id % 10 <> 0 THEN {Y} END AS label FROM o"


def _fold_sql(src: str) -> str:
    return f"""
WITH src AS ({src}),
cnt AS (SELECT label, count(*) AS n_c FROM src GROUP BY label),
off AS (SELECT label, n_c, coalesce(sum(n_c) OVER (ORDER BY label NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cnt),
size AS (SELECT label, f, greatest((n_c - ((f - o) % 5 + 5) % 5 + 4) // 5, 0) AS n FROM off CROSS JOIN range(5) r(f)),
ends AS (SELECT label, f, sum(n) OVER (PARTITION BY label ORDER BY f) AS upto FROM size),
rk AS (SELECT src.*, row_number() OVER (PARTITION BY label ORDER BY {H2}, id) AS r FROM src)
SELECT rk.id, rk.label, CAST(min(ends.f) AS INTEGER) AS fold
FROM rk JOIN ends ON rk.label IS NOT DISTINCT FROM ends.label AND rk.r <= ends.upto GROUP BY rk.id, rk.label"""


@register("fold_sizes", _fold_sql(_LAB_SQL))
def q_fold_sizes(spark, d):
    """The fold of every row."""
    return sp.stratified_folds(_lab(O(spark, d)), "label", ["id"], k=5, h=F.expr(H2), hash_range=10009, small=300)


def _null_lab(spark, d):
    return _lab(O(spark, d)).withColumn("label", F.when(F.col("id") % 10 != 0, F.col("label")))


@register("folds_with_null_labels", _fold_sql(_NULL_LAB_SQL))
def q_folds_with_null_labels(spark, d):
    """X2 on labels with nulls: no row is lost."""
    return sp.stratified_folds(_null_lab(spark, d), "label", ["id"], k=5, h=F.expr(H2), hash_range=10009)


@register("split_with_null_labels", f"""WITH {_split_sql(_NULL_LAB_SQL, H1)
  .replace("ORDER BY cont - fl DESC, label)", "ORDER BY cont - fl DESC, label NULLS LAST)")
  .replace("JOIN quota USING (label)", "JOIN quota ON rk.label IS NOT DISTINCT FROM quota.label")}
SELECT id, label, split FROM sp""")
def q_split_with_null_labels(spark, d):
    """X1 on labels with nulls: the null class is split like the others."""
    return sp.stratified_split(_null_lab(spark, d), "label", ["id"], h=F.expr(H1), hash_range=10007)


@register("background_sample", f"SELECT id, Age, MonthlyIncome FROM o ORDER BY {H1}, id LIMIT 120")
def q_background_sample(spark, d):
    return sp.background_sample(O(spark, d).select("id", "Age", "MonthlyIncome"), ["id"], 120,
                                order=F.expr(H1))


@register("class_weights", f"""
WITH {FIT_SQL}, c AS (SELECT {Y} AS label, count(*) AS count FROM tr GROUP BY 1)
SELECT label, count, (SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count)::DOUBLE AS weight,
  (SELECT sum(count) FILTER (WHERE label = 0) FROM c) / greatest((SELECT coalesce(sum(count) FILTER (WHERE label = 1), 0) FROM c), 1)::DOUBLE AS scale_pos_weight
FROM c""")
def q_class_weights(spark, d):
    lab = O_train(O(spark, d)).select(F.when(F.col("Attrition") == "Yes", 1).otherwise(0).alias("label"))
    return sp.class_weights(lab)


# ---------------------------------------------------------------- validation (I2, I3) and scoring

from ..operators import score as sc  # noqa: E402
from ..operators import validate as va  # noqa: E402

INPUT_O = ["Department", "JobRole", "OverTime", "Age", "MonthlyIncome", "YearsAtCompany",
           "TotalWorkingYears", "YearsInCurrentRole", "YearsWithCurrManager",
           "YearsSinceLastPromotion", "NumCompaniesWorked", "JobSatisfaction",
           "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance"]
NOMINAL_IN = ["Department", "JobRole", "OverTime"]


def _issues_sql() -> str:
    """The I2 rules for view O written out in SQL (rule numbers follow the rule order)."""
    parts, k = [], 0

    def add(field, msg, cond):
        nonlocal k
        m = msg.replace("'", "''")
        parts.append(f"SELECT id, {k} AS rule, '{field}' AS field, '{m}' AS message, 'error' AS severity "
                     f"FROM o WHERE coalesce({cond}, false)")
        k += 1

    strs = {"Department", "JobRole", "OverTime"}
    for f in INPUT_O:
        add(f, va.MSG_REQUIRED, f"{f} IS NULL" + (f" OR trim({f}) = ''" if f in strs else ""))
    for c in va.LIKERT_1_4:
        if c in INPUT_O:
            add(c, va.MSG_LIKERT, f"{c} < 1 OR {c} > 4")
    add("Age", va.MSG_AGE, f"Age < {va.AGE_MIN} OR Age > {va.AGE_MAX}")
    add("MonthlyIncome", va.MSG_INCOME, "MonthlyIncome <= 0")
    for left, right, msg in va.TENURE_RULES:
        add(left, msg, f"{left} > {right}")
    add("OverTime", va.MSG_OVERTIME, "OverTime IS NOT NULL AND OverTime NOT IN ('Yes', 'No')")
    for f in NOMINAL_IN:
        add(f, va.MSG_CATEGORY, f"trim({f}) = ''")
    return " UNION ALL ".join(parts)


@register("validation_issues", _issues_sql())
def q_validation_issues(spark, d):
    return va.validation_issues(O(spark, d), "id", INPUT_O, NOMINAL_IN)


@register("validation_batch", f"""
SELECT CAST(id AS VARCHAR) || '.' || field AS field, message, severity, CAST(rule AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS omitted
FROM ({_issues_sql()}) x""")
def q_validation_batch(spark, d):
    """The whole report."""
    return va.validate_batch(O(spark, d), "id", INPUT_O, NOMINAL_IN)


@register("validation_issues_capped", f"""
WITH iss AS ({_issues_sql()}),
per AS (SELECT id, count(*) AS n FROM iss GROUP BY id),
first20 AS (SELECT id, n, row_number() OVER (ORDER BY id) AS rowpos,
                   sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM (SELECT * FROM per ORDER BY id LIMIT 20) p),
kept AS (SELECT * FROM first20 WHERE cum - n < 20)
SELECT CAST(iss.id AS VARCHAR) || '.' || field AS field, message, severity,
       CAST(rowpos * 1000 + row_number() OVER (PARTITION BY iss.id ORDER BY rule) - 1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS omitted
FROM iss JOIN kept ON iss.id = kept.id
UNION ALL
SELECT 'rows', 'Additional row errors omitted.', 'warning', CAST(1000000000 AS BIGINT), CAST((SELECT count(*) FROM iss) - t AS BIGINT)
FROM (SELECT max(cum) AS t FROM kept) x WHERE t >= 20""")
def q_validation_issues_capped(spark, d):
    """I3 as an upload form shows it: the cap is the feature, the warning says how much it hides."""
    return va.validate_batch(O(spark, d), "id", INPUT_O, NOMINAL_IN, max_errors=va.MAX_BATCH_ERRORS)


# ---------------------------------------------------------------- rows in file order

from ..sources import ordered  # noqa: E402
from ..sources.proxies import table  # noqa: E402

_FILE_ROWS = "SELECT o_orderkey AS rid, row_number() OVER () AS row_number FROM orders"


def _numbered_o(spark, d):
    """View O with each order's row number in its file."""
    rows = ordered.with_row_numbers(table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), "row_number")
    return O(spark, d).join(rows, "id")


@register("rows_in_file_order", "SELECT o_orderkey, row_number() OVER () AS row_number FROM orders")
def q_rows_in_file_order(spark, d):
    """Ids 1..n of a table without an id column."""
    return ordered.with_row_numbers(table(spark, d, "orders")).select("o_orderkey", "row_number")


@register("validation_by_row", f"""WITH r AS ({_FILE_ROWS})
SELECT 'row_' || row_number || '.' || field AS field, message, severity, CAST(rule AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS omitted
FROM ({_issues_sql()}) x JOIN r ON x.id = r.rid""")
def q_validation_by_row(spark, d):
    """I3 with the labels of an upload: ``row_{i}.{field}``."""
    return va.validate_batch(_numbered_o(spark, d), "row_number", INPUT_O, NOMINAL_IN, prefix="row_")


@register("validation_by_row_capped", f"""
WITH r AS ({_FILE_ROWS}),
iss AS (SELECT r.row_number AS rn, rule, field, message, severity FROM ({_issues_sql()}) x JOIN r ON x.id = r.rid),
per AS (SELECT rn, count(*) AS n FROM iss GROUP BY rn),
first20 AS (SELECT rn, n, row_number() OVER (ORDER BY rn) AS rowpos,
                   sum(n) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM (SELECT * FROM per ORDER BY rn LIMIT 20) p),
kept AS (SELECT * FROM first20 WHERE cum - n < 20)
SELECT 'row_' || iss.rn || '.' || field AS field, message, severity,
       CAST(rowpos * 1000 + row_number() OVER (PARTITION BY iss.rn ORDER BY rule) - 1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS omitted
FROM iss JOIN kept ON iss.rn = kept.rn
UNION ALL
SELECT 'rows', 'Additional row errors omitted.', 'warning', CAST(1000000000 AS BIGINT), CAST((SELECT count(*) FROM iss) - t AS BIGINT)
FROM (SELECT max(cum) AS t FROM kept) x WHERE t >= 20""")
def q_validation_by_row_capped(spark, d):
    """I3 as an upload form shows it, in file order: the cap is the feature."""
    return va.validate_batch(_numbered_o(spark, d), "row_number", INPUT_O, NOMINAL_IN, max_errors=va.MAX_BATCH_ERRORS, prefix="row_")


@register("dedup_first_in_file", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS k FROM (SELECT *, row_number() OVER () AS rn FROM lineitem) x) y WHERE k = 1""")
def q_dedup_first_in_file(spark, d):
    """Q5: the first row per id in file order."""
    rows = ordered.with_row_numbers(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return cl.handle_duplicates(rows, "l_orderkey", ["row_number"])


_SEEN = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@register("first_seen_values", "WITH r AS (SELECT *, row_number() OVER () AS rn FROM orders), v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, min(rn) AS first_row FROM r WHERE {c} IS NOT NULL GROUP BY 2" for c in _SEEN)
    + """) SELECT "column", seen, value, first_row FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY first_row) AS INTEGER) AS seen FROM v) x WHERE seen <= 5""")
def q_first_seen_values(spark, d):
    """Q13: the first five values of each column as they come in the file."""
    return ordered.first_seen(ordered.with_row_numbers(table(spark, d, "orders").select(*_SEEN)), _SEEN)


_TEXT_IN = [c for c in INPUT_O if c not in NOMINAL_IN]
_TEXT_BAD = {1: "abc", 2: "1e12", 3: " ", 4: "-3.9", 5: "4.9"}


def _text_case(c: str, k: int) -> str:
    whens = " ".join(f"WHEN (id + {k}) % 50 = {i} THEN '{v}'" for i, v in _TEXT_BAD.items())
    return f"CASE {whens} ELSE CAST({c} AS VARCHAR) END AS {c}"


def _text_issues_sql() -> str:
    num = lambda c: f"trunc(TRY_CAST(trim({c}) AS DOUBLE))"
    rules = [(f, va.MSG_REQUIRED, f"{f} IS NULL OR trim({f}) = ''") for f in INPUT_O]
    tenure = list(dict.fromkeys(f for a, b, _ in va.TENURE_RULES for f in (a, b)))
    rules += [(c, va.MSG_NOT_NUMBER, f"trim({c}) <> '' AND TRY_CAST(trim({c}) AS DOUBLE) IS NULL")
              for c in [*[x for x in va.LIKERT_1_4 if x in INPUT_O], "Age", "MonthlyIncome", *tenure]]
    rules += [(c, va.MSG_LIKERT, f"{num(c)} < 1 OR {num(c)} > 4") for c in va.LIKERT_1_4 if c in INPUT_O]
    rules += [("Age", va.MSG_AGE, f"{num('Age')} < {va.AGE_MIN} OR {num('Age')} > {va.AGE_MAX}"),
              ("MonthlyIncome", va.MSG_INCOME, f"{num('MonthlyIncome')} <= 0")]
    rules += [(a, msg, f"{num(a)} > {num(b)}") for a, b, msg in va.TENURE_RULES]
    rules += [("OverTime", va.MSG_OVERTIME, "OverTime NOT IN ('Yes', 'No')")] + [(f, va.MSG_CATEGORY, f"trim({f}) = ''") for f in NOMINAL_IN]
    return " UNION ALL ".join(
        f"SELECT id, {k} AS rule, '{f}' AS field, '{m.replace(chr(39), chr(39) * 2)}' AS message, 'error' AS severity FROM x WHERE coalesce({cond}, false)"
        for k, (f, m, cond) in enumerate(rules))


@register("validation_of_text_columns", f"""WITH x AS (SELECT id, {', '.join(NOMINAL_IN)},
  {', '.join(_text_case(c, k) for k, c in enumerate(_TEXT_IN))} FROM o)
{_text_issues_sql()}""")
def q_validation_of_text_columns(spark, d):
    """I2 on an upload whose numbers are text, some of them bad, huge, blank or fractional."""
    o = O(spark, d)
    cols = []
    for k, c in enumerate(_TEXT_IN):
        v = F.col(c).cast("string")
        for i, bad in _TEXT_BAD.items():
            v = F.when((F.col("id") + k) % 50 == i, bad).otherwise(v)
        cols.append(v.alias(c))
    return va.validation_issues(o.select("id", *NOMINAL_IN, *cols), "id", INPUT_O, NOMINAL_IN)


# A fixed linear model over view O's columns (the weights are parameters of the query).
SCORE_MODEL = sc.LinearModel(-1.25, {
    "Age": -0.021, "MonthlyIncome": -0.00011, "YearsAtCompany": -0.043, "TotalWorkingYears": 0.017,
    "NumCompaniesWorked": 0.088, "JobSatisfaction": -0.19, "EnvironmentSatisfaction": -0.23,
    "RelationshipSatisfaction": -0.11, "YearsSinceLastPromotion": 0.061, "YearsInCurrentRole": -0.035,
    "YearsWithCurrManager": -0.029, "n_lines": 0.052, "burnout_risk_flag": 0.74,
    "compensation_per_experience": -0.00002})


def _featured_o(spark, d):
    o = O(spark, d)
    return fe.apply_features(o, fe.fit_feature_state(O_train(o)))


def _model_rows(spark, d):
    """View O with the derived columns that ``SCORE_MODEL`` reads (none of them needs fitted state)."""
    return fe.apply_features(O(spark, d), None, features=[f for f in SCORE_MODEL.weights if f in fe.INPUTS_OF])


_FE_O_SQL = _FE_SQL.replace("SELECT id,\n", "SELECT o_id AS id,\n", 1)
_LOGIT_SQL = f"{SCORE_MODEL.intercept}e0 + " + " + ".join(
    f"({w!r}e0) * CAST({f} AS DOUBLE)" if "e" not in repr(w) else f"({w!r}) * CAST({f} AS DOUBLE)"
    for f, w in SCORE_MODEL.weights.items())
_FEATURED_SQL = f"""fx AS (
  SELECT o.*, CAST(coalesce(OverTime = 'Yes' AND WorkLifeBalance <= 2, false) AS INTEGER) AS burnout_risk_flag,
         MonthlyIncome / (CASE WHEN TotalWorkingYears < 1 THEN 1 ELSE TotalWorkingYears END)::DOUBLE AS compensation_per_experience
  FROM o)"""


@register("score_batch", f"""WITH {_FEATURED_SQL},
pz AS (SELECT id, 1e0 / (1e0 + exp(-({_LOGIT_SQL}))) AS p FROM fx)
SELECT id AS EmployeeID, round_even(p, 4) AS AttritionProbability,
  CASE WHEN p >= 0.5e0 THEN 'Yes' ELSE 'No' END AS PredictedAttrition,
  CASE WHEN p >= 0.6e0 THEN 'High' WHEN p >= 0.4e0 THEN 'Elevated' WHEN p >= 0.25e0 THEN 'Moderate' ELSE 'Low' END AS RiskTier,
  round_even(abs(p - 0.5e0) * 2e0, 4) AS ConfidenceScore
FROM pz""")
def q_score_batch(spark, d):
    return sc.prediction_frame(sc.predict_linear(_model_rows(spark, d), SCORE_MODEL, "id"), "id")


@register("score_rows_with_nulls", f"""WITH {_FEATURED_SQL.replace('SELECT o.*,', "SELECT o.* REPLACE (CASE WHEN id % 6 <> 0 THEN Age END AS Age),")},
pz AS (SELECT id, 1e0 / (1e0 + exp(-({_LOGIT_SQL}))) AS p FROM fx)
SELECT id AS EmployeeID, round_even(p, 4) AS AttritionProbability,
  CASE WHEN p >= 0.5e0 THEN 'Yes' WHEN p < 0.5e0 THEN 'No' END AS PredictedAttrition,
  CASE WHEN p >= 0.6e0 THEN 'High' WHEN p >= 0.4e0 THEN 'Elevated' WHEN p >= 0.25e0 THEN 'Moderate' WHEN p IS NOT NULL THEN 'Low' END AS RiskTier,
  round_even(abs(p - 0.5e0) * 2e0, 4) AS ConfidenceScore
FROM pz""")
def q_score_rows_with_nulls(spark, d):
    """A row that cannot be scored has no label, tier or confidence, and is not dropped."""
    fx = _model_rows(spark, d).withColumn("Age", F.when(F.col("id") % 6 != 0, F.col("Age")))
    return sc.prediction_frame(sc.predict_linear(fx, SCORE_MODEL, "id"), "id")


@register("contributions_add_up", "SELECT id, true AS adds_up FROM o")
def q_contributions_add_up(spark, d):
    """Base value plus all contributions is the row's logit."""
    fx = _model_rows(spark, d)
    parts = sc.linear_contributions(fx, SCORE_MODEL, "id", top_n=None).groupBy("id").agg(
        (F.max("base_value") + F.sum("shap_value")).alias("z"))
    logit = fx.select("id", SCORE_MODEL.logit().alias("logit"))
    return logit.join(parts, "id").select("id", (F.abs(F.col("z") - F.col("logit")) < 1e-9).alias("adds_up"))


@register("tier_counts", f"""WITH {_FEATURED_SQL},
pz AS (SELECT 1e0 / (1e0 + exp(-({_LOGIT_SQL}))) AS p FROM fx)
SELECT CASE WHEN p >= 0.6e0 THEN 'High' WHEN p >= 0.4e0 THEN 'Elevated' WHEN p >= 0.25e0 THEN 'Moderate' ELSE 'Low' END AS RiskTier,
       count(*) AS count FROM pz GROUP BY 1""")
def q_tier_counts(spark, d):
    pred = sc.prediction_frame(sc.predict_linear(_model_rows(spark, d), SCORE_MODEL, "id"), "id")
    return seg.tier_counts(pred)


_FEATS = list(SCORE_MODEL.weights)


@register("linear_contributions_top12", f"""WITH {_FEATURED_SQL},
mu AS (SELECT {', '.join(f'round_even(avg(CAST({f} AS DOUBLE)), 6) AS m_{f}' for f in _FEATS)} FROM fx),
phi AS ({' UNION ALL '.join(
    f"SELECT id, '{f}' AS feature, ({SCORE_MODEL.weights[f]!r}) * (CAST({f} AS DOUBLE) - m_{f}) AS shap_value, "
    f"CAST({f} AS DOUBLE) AS feature_value FROM fx CROSS JOIN mu" for f in _FEATS)}),
base AS (SELECT {SCORE_MODEL.intercept!r} + {' + '.join(f'({SCORE_MODEL.weights[f]!r}) * m_{f}' for f in _FEATS)} AS b FROM mu),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(shap_value) DESC, feature) AS rank FROM phi)
SELECT id, rank, feature, shap_value, feature_value,
  CASE WHEN shap_value >= 0 THEN 'Increases risk' ELSE 'Decreases risk' END AS direction,
  b AS base_value
FROM rk CROSS JOIN base WHERE rank <= 12""")
def q_linear_contributions_top12(spark, d):
    fx = _model_rows(spark, d)
    means = {k: round(v, 6) for k, v in sc.background_means(fx, _FEATS).items()}
    out = sc.linear_contributions(fx, SCORE_MODEL, "id", means=means)
    return out.select("id", "rank", "feature", "shap_value", "feature_value", "direction", "base_value")


# ---------------------------------------------------------------- models (L*, M15): rows-only checks

from ..plans import modeling as ml  # noqa: E402
from ..plans import pipelines as pl  # noqa: E402

ML_NUMERIC = ["Age", "MonthlyIncome", "YearsAtCompany", "TotalWorkingYears", "YearsInCurrentRole",
              "YearsWithCurrManager", "YearsSinceLastPromotion", "NumCompaniesWorked",
              "JobSatisfaction", "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance",
              "n_lines", "qty", "max_discount"]
ML_NOMINAL = ["Department", "JobRole", "OverTime", "Region"]
#: Forest size of the registered model queries (a parameter; the library's default is 300 trees, depth 30).
ML_FOREST = {"num_trees": 100, "max_depth": 10}


def _labelled(spark, d):
    o = O(spark, d)
    return o.withColumn("label", F.when(F.col("Attrition") == "Yes", 1).otherwise(0))


@register("rf_importance")
def q_rf_importance(spark, d):
    """L9 over every row of the exact train split."""
    train = sp.stratified_split(_labelled(spark, d), "label", ["id"]).filter(F.col("split") == "train")
    return ml.rf_importance(train, ML_NOMINAL, ML_NUMERIC, "label", **ML_FOREST)


@register("rf_importance_total", "SELECT 1e0 AS total")
def q_rf_importance_total(spark, d):
    """Impurity importances add up to one."""
    train = _labelled(spark, d).filter("label is not null")
    imp = ml.rf_importance(train, ML_NOMINAL, ML_NUMERIC, "label", num_trees=5, max_depth=5)
    return imp.agg(F.round(F.sum("importance"), 3).alias("total"))


def _features(spark, d):
    return pl.run_feature_engineering(O(spark, d), "id", ML_NOMINAL, ML_NUMERIC, **ML_FOREST)


@register("model_comparison")
def q_model_comparison(spark, d):
    """L8 + M15 on the selected features: five folds, the short grid."""
    return pl.run_evaluation(_features(spark, d), ML_NOMINAL, "id", folds=5, full_grid=False)["comparison"]


@register("selected_features")
def q_selected_features(spark, d):
    """Every candidate, whether it is kept, and why it is not."""
    res = _features(spark, d)
    rows = [(f, f not in res["dropped"]) for f in ML_NOMINAL + ML_NUMERIC + fe.ENGINEERED]
    why = pl.decisions_table(spark, res["decisions"]).withColumnRenamed("dropped_feature", "feature")
    return spark.createDataFrame(rows, "feature string, selected boolean").join(why, "feature", "left")


# ---------------------------------------------------------------- labels, long forms, schema

from ..functions.exprs import display_name, score_label, status_label  # noqa: E402


@register("status_labels", """
SELECT id, CASE WHEN Attrition = 'Yes' THEN 'Left' WHEN Attrition = 'No' THEN 'Stayed' END AS Status,
  CASE WHEN JobSatisfaction = 1 THEN '1 — Low' WHEN JobSatisfaction = 4 THEN '4 — High'
       WHEN JobSatisfaction IS NOT NULL THEN CAST(JobSatisfaction AS VARCHAR) END AS JobSatisfactionLabel,
  CASE WHEN WorkLifeBalance = 1 THEN '1 — Poor' WHEN WorkLifeBalance = 4 THEN '4 — Good'
       WHEN WorkLifeBalance IS NOT NULL THEN CAST(WorkLifeBalance AS VARCHAR) END AS WorkLifeBalanceLabel
FROM o""")
def q_status_labels(spark, d):
    o = O(spark, d)
    return o.select("id", status_label("Attrition").alias("Status"),
                    score_label("JobSatisfaction", "Low", "High").alias("JobSatisfactionLabel"),
                    score_label("WorkLifeBalance", "Poor", "Good").alias("WorkLifeBalanceLabel"))


_M8 = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "balanced_accuracy", "mcc"]


@_score("metrics_long", f"""WITH {_MET_SQL},
cmp AS (SELECT m.model, {', '.join(f'round_even({c}, 4) AS {c}' for c in ['accuracy', 'precision', 'recall', 'f1', 'roc_auc', 'pr_auc', 'balanced_accuracy', 'mcc'])}
        FROM m JOIN auc ON m.model = auc.model JOIN ap ON m.model = ap.model)
{' UNION ALL '.join(f"SELECT upper(substr(model, 1, 1)) || substr(model, 2) AS model, '{c}' AS Metric, {c} AS Score FROM cmp" for c in _M8)}""")
def q_metrics_long(spark, d):
    cmp = mt.metrics_comparison(C(spark, d))
    long = cmp.unpivot(["model"], _M8, "Metric", "Score")
    return long.select(display_name("model").alias("model"), "Metric", "Score")


REGISTRY_O = {"id": "id", "Attrition": "target", "Department": "nominal", "JobRole": "nominal",
              "OverTime": "nominal", "Age": "continuous", "MonthlyIncome": "continuous",
              "YearsAtCompany": "continuous", "TotalWorkingYears": "continuous",
              "YearsInCurrentRole": "continuous", "YearsWithCurrManager": "continuous",
              "YearsSinceLastPromotion": "continuous", "NumCompaniesWorked": "continuous",
              "JobSatisfaction": "ordinal", "EnvironmentSatisfaction": "ordinal",
              "RelationshipSatisfaction": "ordinal", "WorkLifeBalance": "ordinal",
              "StandardHours": "drop", "Education": "ordinal", "StockOptionLevel": "ordinal"}


@register("schema_check", "SELECT \"column\", role, dtype, CASE WHEN dtype IS NULL THEN 'missing' "
          "WHEN role IS NULL THEN 'unregistered' ELSE 'ok' END AS status FROM (VALUES "
          + ", ".join(f"('{c}', '{r}')" for c, r in REGISTRY_O.items()) + ") r(\"column\", role) FULL JOIN (VALUES "
          + ", ".join(f"('{c}', '{t}')" for c, t in O_SCHEMA) + ") a(\"column\", dtype) USING (\"column\")")
def q_schema_check(spark, d):
    return pf.schema_check(O(spark, d), REGISTRY_O)


_SCALE4 = ("scores from 1 to 4, ordered", "keep as a number", 1, 4)
SPECS_O = [pf.FeatureSpec(*x) for x in (
    ("id", "identifier", "order key", "leave out of models", "one value a row carries no pattern"),
    ("Attrition", "target", "whether the order is finished", "encode as 0 and 1", "what models predict", None, None, "Yes|No"),
    ("Department", "nominal", "market segment", "one-hot", "no order among segments", None, None, "AUTOMOBILE|BUILDING|FURNITURE|HOUSEHOLD|MACHINERY"),
    ("JobRole", "nominal", "priority", "one-hot", "read as names here"),
    ("Region", "nominal", "customer's region", "one-hot", "names known so far", None, None, "AFRICA|AMERICA|ASIA|EUROPE"),
    ("OverTime", "binary", "every third key", "one-hot", "two names", None, None, "Yes|No"),
    ("Age", "continuous", "years", "keep", "from 18 to 60", 18, 60),
    ("MonthlyIncome", "continuous", "a part of the total price", "scale", "wide range", 0, None),
    ("YearsAtCompany", "continuous", "years", "keep", "below 15", 0, 14),
    ("TotalWorkingYears", "continuous", "years", "keep", "checked for over 20", 0, 20),
    ("YearsInCurrentRole", "continuous", "years", "keep", "not above the years at the company", 0, 14),
    ("YearsWithCurrManager", "continuous", "years", "keep", "not above the years at the company", 0, 14),
    ("YearsSinceLastPromotion", "continuous", "years", "keep", "below 7", 0, 6),
    ("NumCompaniesWorked", "continuous", "count", "keep", "below 10", 0, 9),
    *((c, "ordinal", "answer", _SCALE4[1], _SCALE4[0], *_SCALE4[2:])
      for c in ("JobSatisfaction", "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance", "Education")),
    ("StandardHours", "constant", "hours a fortnight", "drop", "one value in all rows", 80, 80),
    ("n_lines", "continuous", "lines of the order", "keep", "count", 0, None),
    ("max_discount", "continuous", "largest discount of a line", "keep", "a share", 0, 1),
)]


def _sql_text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _held_sql(c: str, t: str) -> str:
    s = next((s for s in SPECS_O if s.column == c), None)
    x = f"CASE WHEN NOT {_miss(c, t)} THEN {c} END"
    outside = "false"
    if s is not None and t != "string":
        outside = " OR ".join([f"{x} < {s.lower}"] * (s.lower is not None) + [f"{x} > {s.upper}"] * (s.upper is not None)) or outside
    elif s is not None and s.values is not None:
        outside = f"{x} NOT IN ({', '.join(_sql_text(v) for v in s.values.split('|'))})"
    low, high = (f"CAST({f}({x}) AS DOUBLE)" if t != "string" else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
    return (f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER (WHERE {_miss(c, t)}) AS missing, {low} AS min, {high} AS max,
count(*) FILTER (WHERE {outside}) AS outside, count(DISTINCT {x}) = 1 AS constant FROM o""")


@register("feature_registry", f"""WITH s("column", kind, description, action, justification) AS (VALUES {', '.join(
    '(' + ', '.join(_sql_text(x) for x in s[:5]) + ')' for s in SPECS_O)}),
h AS ({' UNION ALL '.join(_held_sql(c, t) for c, t in O_SCHEMA)})
SELECT "column", kind, description, action, justification, dtype, missing, min, max, outside,
  CASE WHEN dtype IS NULL THEN 'missing' WHEN kind IS NULL THEN 'unregistered' WHEN constant AND kind <> 'constant' THEN 'constant'
       WHEN outside > 0 THEN 'outside' ELSE 'ok' END AS status
FROM s FULL JOIN h USING ("column")""")
def q_feature_registry(spark, d):
    """Q14: the registry held against every cell of view O."""
    return pf.feature_registry(O(spark, d), SPECS_O)


GROUPS_O = {"Demographics": ["Age", "Region"], "Job": ["Department", "JobRole", "OverTime"],
            "Compensation": ["MonthlyIncome"],
            "Tenure": ["YearsAtCompany", "TotalWorkingYears", "YearsInCurrentRole", "YearsWithCurrManager",
                       "YearsSinceLastPromotion", "NumCompaniesWorked"],
            "Satisfaction": ["JobSatisfaction", "EnvironmentSatisfaction", "RelationshipSatisfaction",
                             "WorkLifeBalance"]}
_TYPES_O = dict(O_SCHEMA)


@register("column_groups", " UNION ALL ".join(
    f"SELECT '{g}' AS \"group\", '{c}' AS \"column\", '{_TYPES_O[c]}' AS dtype, count(DISTINCT {c}) AS unique_values FROM o"
    for g, cols in GROUPS_O.items() for c in cols))
def q_column_groups(spark, d):
    return pf.column_groups(O(spark, d), GROUPS_O)


@register("column_verification")
def q_column_verification(spark, d):
    # rows-only: the sample text follows Spark's number formatting
    return pf.column_verification(O(spark, d))


_FE_CTES = _FE_SQL[:_FE_SQL.index("SELECT id,\n")].rstrip()
_SAT = ["JobSatisfaction", "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance"]


_FORMULAS = {
    "promotion_stagnation_ratio": "YearsSinceLastPromotion / max(YearsAtCompany, 1)",
    "role_tenure_share": "YearsInCurrentRole / max(YearsAtCompany, 1)",
    "manager_tenure_share": "YearsWithCurrManager / max(YearsAtCompany, 1)",
    "income_vs_role_median": "MonthlyIncome / median MonthlyIncome of the JobRole (train rows)",
    "compensation_per_experience": "MonthlyIncome / max(TotalWorkingYears, 1)",
    "avg_satisfaction_score": "mean of the non-null satisfaction columns",
    "burnout_risk_flag": "OverTime = 'Yes' and WorkLifeBalance <= 2",
    "job_stability_index": "TotalWorkingYears / max(NumCompaniesWorked, 1)"}


@register("engineered_feature_report", f"""WITH e AS ({_FE_SQL})
""" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {_sql_text(text)} AS formula, count({f}) AS "values", count(*) - count({f}) AS nulls,
CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max FROM e""" for f, text in _FORMULAS.items()))
def q_engineered_feature_report(spark, d):
    """Q16: the catalog beside the derived columns of all rows."""
    return fe.engineered_feature_report(_featured_o(spark, d)).withColumns({c: _round(c) for c in ("min", "max")})


@register("feature_sanity_rates", f"""{_FE_CTES},
f AS (SELECT ({Y})::DOUBLE AS y,
        CAST(coalesce(OverTime = 'Yes' AND WorkLifeBalance <= 2, false) AS INTEGER) AS b,
        ({' + '.join(f'coalesce({c}, 0)' for c in _SAT)})::DOUBLE
          / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in _SAT)}, 0) AS s,
        MonthlyIncome / nullif(med, 0) AS m FROM x)
SELECT round_even(avg(CASE WHEN b = 0 THEN y END) * 100e0, 6) AS no_burnout_pct,
       round_even(avg(CASE WHEN b = 1 THEN y END) * 100e0, 6) AS burnout_pct,
       round_even(avg(CASE WHEN s <= 2 THEN y END) * 100e0, 6) AS low_satisfaction_pct,
       round_even(avg(CASE WHEN s >= 3.5 THEN y END) * 100e0, 6) AS high_satisfaction_pct,
       round_even(avg(CASE WHEN m < 1.0 THEN y END) * 100e0, 6) AS below_role_median_pct,
       round_even(avg(CASE WHEN m >= 1.0 THEN y END) * 100e0, 6) AS at_or_above_role_median_pct
FROM f""")
def q_feature_sanity_rates(spark, d):
    return seg.feature_sanity_rates(_featured_o(spark, d))


@register("lr_top_features")
def q_lr_top_features(spark, d):
    """L12 over a logistic regression tuned with five folds (rows-only: coefficients come from the fit)."""
    train = sp.stratified_split(_labelled(spark, d), "label", ["id"]).filter(F.col("split") == "train")
    prepared = ml.prepare(train, "label", ["id"], 5)
    spec = [m for m in ml.model_specs(full_grid=False) if m.name == "logistic_regression"][0]
    return ml.feature_importance(ml.train_single_model(spec, prepared, ML_NOMINAL, ML_NUMERIC, folds=5), top_n=15)


@register("preprocessed_table", f"""WITH d AS ({DUP_SQL}),
u AS (SELECT * EXCLUDE (src, rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src) AS rn FROM d) t WHERE rn = 1),
mom AS (SELECT avg(MonthlyIncome::DOUBLE) AS m, stddev_pop(MonthlyIncome::DOUBLE) AS s FROM u)
SELECT id, Attrition, CAST({Y} AS INTEGER) AS Attrition_label,
  {', '.join(f"CAST(coalesce(Region = '{v}', false) AS DOUBLE) AS \"Region_{v}\"" for v in _CATS['Region'][1:])},
  round_even((MonthlyIncome - m) / s, 6) AS MonthlyIncome, CAST(Age AS DOUBLE) AS Age FROM u CROSS JOIN mom""")
def q_preprocessed_table(spark, d):
    """T7 (with Q5, Q6, Q8, T1–T6): the output of the preprocessing pipeline on a table with duplicates."""
    o = O(spark, d)
    pre, _ = pl.run_preprocessing(duplicates_view(o), "id", ["src"], ["StandardHours"], ["Region"], ["MonthlyIncome", "Age"], scale=["MonthlyIncome"])
    return pre.withColumn("MonthlyIncome", _round("MonthlyIncome"))


_REGION_FEATURES = ", ".join([*(f"Region_{v}" for v in _CATS["Region"][1:]), "MonthlyIncome", "Age"])


@register("preprocessing_log", f"""WITH d AS ({DUP_SQL}),
u AS (SELECT * EXCLUDE (src, rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src) AS rn FROM d) t WHERE rn = 1),
c AS (SELECT (SELECT count(*) FROM d) AS n_in, (SELECT count(*) FROM u) AS n_kept, (SELECT count(*) FROM u WHERE Attrition = 'Yes') AS pos,
        (SELECT {_MISSING_SUM} FROM u) AS gaps),
g AS (SELECT coalesce(string_agg("column", ', ' ORDER BY k), '') AS names FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS k, count(*) FILTER (WHERE {_miss(c, t)}) AS missing FROM u" for i, (c, t) in enumerate(O_SCHEMA)) + f""") m WHERE missing > 0)
SELECT 1 AS position, 'input' AS step, n_in AS n_rows, {len(O_SCHEMA)} AS n_columns, 0::BIGINT AS n_changed, 'rows as read' AS detail FROM c
UNION ALL SELECT 2, 'deduplicate', n_kept, {len(O_SCHEMA)}, n_in - n_kept, 'first row per id' FROM c
UNION ALL SELECT 3, 'missing', n_kept, {len(O_SCHEMA)}, gaps, names FROM c CROSS JOIN g
UNION ALL SELECT 4, 'drop', n_kept, {len(O_SCHEMA) - 1}, 1, 'StandardHours' FROM c
UNION ALL SELECT 5, 'target', n_kept, {len(O_SCHEMA)}, pos, 'Yes is 1, No is 0' FROM c
UNION ALL SELECT 6, 'encode', n_kept, {len(_CATS["Region"]) + 4}, {len(_CATS["Region"]) + 1}, '{_REGION_FEATURES}' FROM c""")
def q_preprocessing_log(spark, d):
    """Q17: the decision log of a preprocessing run on a table with duplicates."""
    _, log = pl.logged_preprocessing(duplicates_view(O(spark, d)), "id", ["src"], ["StandardHours"], ["Region"],
                                     ["MonthlyIncome", "Age"], scale=["MonthlyIncome"])
    return log


@register("cleaned_table", "SELECT * EXCLUDE (StandardHours, WorkLifeBalance, qty, max_discount) FROM o")
def q_cleaned_table(spark, d):
    """Q9: drop, no-missing check, label check."""
    return cl.clean_raw_data(O(spark, d), ["StandardHours", "WorkLifeBalance", "qty", "max_discount"])
