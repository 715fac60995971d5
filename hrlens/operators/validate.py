"""Record validation as one projection over the whole table.

Each rule becomes ``when(bad, struct(rule, field, message, severity))``;
the array of issues is filtered and exploded.  No Python runs per row.
Comparisons follow ``int(value)`` truncation, done on doubles so that no
value can overflow, and a present value that is not a finite number gets its
own issue instead of an exception.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from ..functions.exprs import col, lit_d

# Fixed values that must equal the reference's validation rules.
AGE_MIN, AGE_MAX = 18, 70
MAX_BATCH_ERRORS = 20  # where an upload form stops; the library's default is the whole report
LIKERT_1_4 = ["EnvironmentSatisfaction", "JobInvolvement", "JobSatisfaction",
              "RelationshipSatisfaction", "WorkLifeBalance"]
MSG_REQUIRED = "Required field is missing."
MSG_LIKERT = "Must be between 1 and 4."
MSG_EDUCATION = "Must be between 1 and 5."
MSG_STOCK = "Must be between 0 and 3."
MSG_PERFORMANCE = "Must be 3 or 4 (values observed in training data)."
MSG_AGE = f"Must be between {AGE_MIN} and {AGE_MAX}."
MSG_INCOME = "Must be greater than zero."
TENURE_RULES = [
    ("YearsInCurrentRole", "YearsAtCompany", "Role tenure cannot exceed company tenure."),
    ("YearsWithCurrManager", "YearsAtCompany", "Manager tenure cannot exceed company tenure."),
    ("YearsSinceLastPromotion", "YearsAtCompany", "Years since promotion cannot exceed company tenure."),
    ("YearsAtCompany", "TotalWorkingYears", "Company tenure cannot exceed total working years."),
]
MSG_OVERTIME = "Must be 'Yes' or 'No'."
MSG_CATEGORY = "Invalid category."
MSG_NOT_NUMBER = "Must be a number."
MSG_MISSING_COLUMNS = "Missing required columns: "
MSG_EMPTY = "Upload contains no data rows."
MSG_OMITTED = "Additional row errors omitted."


def _value(df: DataFrame, c: str) -> Column:
    """The value as a finite double, else null."""
    text = isinstance(df.schema[c].dataType, T.StringType)
    x = F.trim(col(c)).try_cast("double") if text else col(c).cast("double")
    return F.when(F.abs(x) < lit_d(float("inf")), x)


def _num(df: DataFrame, c: str) -> Column:
    """``int(value)`` as a double; non-numbers → null."""
    x = _value(df, c)
    return x - x % lit_d(1.0)


def _not_number(df: DataFrame, c: str) -> Column | None:
    """A present value that is no finite number; impossible for integer columns."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):
        return (F.trim(col(c)) != "") & _value(df, c).isNull()
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return col(c).isNotNull() & _value(df, c).isNull()
    return None


def _issue(rule: int, field: str, message: Column | str, bad: Column) -> Column:
    msg = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(bad, F.lit(False)),
                  F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"),
                           msg.alias("message"), F.lit("error").alias("severity")))


def issue_array(df: DataFrame, input_columns: Sequence[str], nominal: Sequence[str]) -> Column:
    """All I2 rules for one row, in the reference's order, as array<struct>."""
    present = set(df.columns)
    rules: list[Column] = []
    k = 0

    def add(field, message, bad):
        nonlocal k
        rules.append(_issue(k, field, message, bad))
        k += 1

    for f in input_columns:
        if f in present:
            v = col(f)
            blank = (F.trim(v) == "") if isinstance(df.schema[f].dataType, T.StringType) else F.lit(False)
            add(f, MSG_REQUIRED, v.isNull() | blank)
        else:
            add(f, MSG_REQUIRED, F.lit(True))
    ranges = [(c, 1, 4, MSG_LIKERT) for c in LIKERT_1_4] + [
        ("Education", 1, 5, MSG_EDUCATION), ("StockOptionLevel", 0, 3, MSG_STOCK)]
    tenure = list(dict.fromkeys(f for left, right, _ in TENURE_RULES for f in (left, right)))
    for c in [*(r[0] for r in ranges), "PerformanceRating", "Age", "MonthlyIncome", *tenure]:
        nn = _not_number(df, c) if c in present else None
        if nn is not None:
            add(c, MSG_NOT_NUMBER, nn)
    for c, lo, hi, msg in ranges:
        if c in present:
            x = _num(df, c)
            add(c, msg, (x < lo) | (x > hi))
    if "PerformanceRating" in present:
        x = _num(df, "PerformanceRating")
        add("PerformanceRating", MSG_PERFORMANCE, ~x.isin(3, 4))
    if "Age" in present:
        x = _num(df, "Age")
        add("Age", MSG_AGE, (x < AGE_MIN) | (x > AGE_MAX))
    if "MonthlyIncome" in present:
        add("MonthlyIncome", MSG_INCOME, _num(df, "MonthlyIncome") <= 0)
    for left, right, msg in TENURE_RULES:
        if left in present and right in present:
            add(left, msg, _num(df, left) > _num(df, right))
    if "OverTime" in present:
        add("OverTime", MSG_OVERTIME, col("OverTime").isNotNull() & ~col("OverTime").isin("Yes", "No"))
    for f in nominal:
        if f in present and isinstance(df.schema[f].dataType, T.StringType):
            add(f, MSG_CATEGORY, F.trim(col(f)) == "")
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def validation_issues(df: DataFrame, id_col: str, input_columns: Sequence[str],
                      nominal: Sequence[str]) -> DataFrame:
    """I2 over every row: (id, rule, field, message, severity), one row per issue."""
    return (df.select(col(id_col).alias(id_col), F.explode(issue_array(df, input_columns, nominal)).alias("i"))
              .select(id_col, "i.rule", "i.field", "i.message", "i.severity"))


REPORT_SCHEMA = "field string, message string, severity string, seq long, omitted long"


def validate_batch(df: DataFrame, id_col: str, input_columns: Sequence[str],
                   nominal: Sequence[str], max_errors: int | None = None, prefix: str = "") -> DataFrame:
    """Missing columns → one error; empty → one error; else every issue of every row, labelled
    ``<prefix><id>.<field>``; ``seq`` is the issue's rule.  With row numbers as ids and the prefix
    ``row_`` these are the labels of an upload (``sources.ordered``).

    With ``max_errors``, the report stops after the row (in id order) that reaches that many errors,
    ``seq`` orders it, and a warning carries the number of issues left out.  The cut row is found
    from at most ``max_errors`` (id, count) pairs (``orderBy(id).limit``: no global sort).  The table is
    read once; all else comes from the written rows that have issues.
    """
    spark = df.sparkSession
    missing = [c for c in input_columns if c not in df.columns]
    if missing:
        return spark.createDataFrame([("columns", MSG_MISSING_COLUMNS + ", ".join(missing), "error", 0, None)], REPORT_SCHEMA)
    found = df.select(col(id_col).alias("_id"), issue_array(df, input_columns, nominal).alias("_iss"))
    label = F.concat(F.lit(prefix), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.lit("."), F.col("i.field")).alias("field")
    none = F.lit(None).cast("long").alias("omitted")
    empty = spark.createDataFrame([("rows", MSG_EMPTY, "error", 0, None)], REPORT_SCHEMA)
    if max_errors is None:
        return empty if df.isEmpty() else found.select("_id", F.explode("_iss").alias("i")).select(
            label, F.col("i.message").alias("message"), F.col("i.severity").alias("severity"),
            F.col("i.rule").cast("long").alias("seq"), none)
    # exploded, not filtered: rows without issues go without a condition on the rules' expression
    issues = written(found.select("_id", F.posexplode("_iss").alias("_k", "i")), "issues")
    per_row = issues.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    kept, shown = [], 0
    for pos, row in enumerate(per_row.orderBy("_id").limit(max_errors).collect(), start=1):
        kept.append((row["_id"], pos))
        shown += row["_n"]
        if shown >= max_errors:
            break
    if not kept:
        return empty if df.isEmpty() else spark.createDataFrame([], REPORT_SCHEMA)
    order = spark.createDataFrame(kept, f"_id {dict(df.dtypes)[id_col]}, _rowpos long")  # at most max_errors rows
    shown_issues = (issues.join(F.broadcast(order), "_id")
              .select(label, F.col("i.message").alias("message"), F.col("i.severity").alias("severity"),
                      (F.col("_rowpos") * 1000 + F.col("_k")).cast("long").alias("seq"), none))
    if shown >= max_errors:
        total = issues.agg(F.count(F.lit(1)).alias("n"))
        shown_issues = shown_issues.unionByName(total.select(
            F.lit("rows").alias("field"), F.lit(MSG_OMITTED).alias("message"), F.lit("warning").alias("severity"),
            F.lit(10**9).cast("long").alias("seq"), (F.col("n") - F.lit(shown)).cast("long").alias("omitted")))
    return shown_issues
