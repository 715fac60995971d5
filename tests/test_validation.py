"""I2 rules: a valid record, one negative case per rule, text columns, and the batch report."""
from pyspark.sql import types as T

from hrlens.operators import validate as va
from hrlens.sources.io import EMPLOYEE_SCHEMA

NOT_INPUT = {"EmployeeNumber", "Attrition", "EmployeeCount", "StandardHours", "Over18", "JobLevel"}
FIELDS = [f for f in EMPLOYEE_SCHEMA.fields if f.name not in NOT_INPUT]
INPUTS = [f.name for f in FIELDS]
NOMINAL = [f.name for f in FIELDS if isinstance(f.dataType, T.StringType)]
TYPES = {f.name: f.dataType.simpleString() for f in FIELDS}


def valid():
    """Numbers that satisfy every range and tenure rule; any text will do for a nominal field."""
    rec = {c: "unit" if c in NOMINAL else 4 for c in INPUTS}
    return rec | {"OverTime": "Yes", "Age": 44, "StockOptionLevel": 0, "TotalWorkingYears": 9, "YearsAtCompany": 7}


def frame(spark, recs, types=TYPES):
    schema = "id int, " + ", ".join(f"`{c}` {types[c]}" for c in INPUTS)
    return spark.createDataFrame([(i, *[r.get(c) for c in INPUTS]) for i, r in enumerate(recs)], schema)


def issues(spark, recs, types=TYPES):
    rows = va.validation_issues(frame(spark, recs, types), "id", INPUTS, NOMINAL).collect()
    return sorted((r.id, r.rule, r.field, r.message) for r in rows)


def test_valid_record_has_no_error(spark):
    assert issues(spark, [valid()]) == []


TENURE = {left: msg for left, _, msg in va.TENURE_RULES}
CASES = [
    ({"Department": "  "}, [("Department", va.MSG_REQUIRED), ("Department", va.MSG_CATEGORY)]),
    ({"JobInvolvement": 0}, [("JobInvolvement", va.MSG_LIKERT)]),
    ({"Education": 6}, [("Education", va.MSG_EDUCATION)]),
    ({"StockOptionLevel": -1}, [("StockOptionLevel", va.MSG_STOCK)]),
    ({"PerformanceRating": 5}, [("PerformanceRating", va.MSG_PERFORMANCE)]),
    ({"Age": va.AGE_MIN - 1}, [("Age", va.MSG_AGE)]),
    ({"Age": va.AGE_MAX + 1}, [("Age", va.MSG_AGE)]),
    ({"MonthlyIncome": -4}, [("MonthlyIncome", va.MSG_INCOME)]),
    *[({f: 8}, [(f, TENURE[f])]) for f in ("YearsInCurrentRole", "YearsWithCurrManager", "YearsSinceLastPromotion")],
    ({"YearsAtCompany": 10}, [("YearsAtCompany", TENURE["YearsAtCompany"])]),
    ({"OverTime": "often"}, [("OverTime", va.MSG_OVERTIME)]),
    ({"HourlyRate": None}, [("HourlyRate", va.MSG_REQUIRED)]),
]


def test_each_rule(spark):
    got = issues(spark, [valid() | change for change, _ in CASES])
    for i, (_, expected) in enumerate(CASES):
        assert [(f, m) for k, _, f, m in got if k == i] == expected


def test_numbers_as_text(spark):
    types = {c: "string" for c in INPUTS}
    text = {c: str(v) for c, v in valid().items()}
    recs = [text, text | {"Age": "abc"}, text | {"MonthlyIncome": "1e300"}, text | {"MonthlyIncome": "12345678901234567890"},
            text | {"JobSatisfaction": "4.9"}, text | {"JobSatisfaction": " 5 "}, text | {"TotalWorkingYears": "x"},
            text | {"PerformanceRating": "?"}, text | {"Education": "NaN"}]
    assert [(i, f, m) for i, _, f, m in issues(spark, recs, types)] == [
        (1, "Age", va.MSG_NOT_NUMBER), (5, "JobSatisfaction", va.MSG_LIKERT), (6, "TotalWorkingYears", va.MSG_NOT_NUMBER),
        (7, "PerformanceRating", va.MSG_NOT_NUMBER), (8, "Education", va.MSG_NOT_NUMBER)]


def test_huge_integers_do_not_abort(spark):
    types = TYPES | {"MonthlyIncome": "bigint", "Age": "bigint"}
    assert [(f, m) for _, _, f, m in issues(spark, [valid() | {"MonthlyIncome": 10 ** 15, "Age": 10 ** 12}], types)] == [("Age", va.MSG_AGE)]


def test_batch_report(spark):
    short = va.validate_batch(spark.createDataFrame([(1, "x")], "id int, Department string"), "id", INPUTS, NOMINAL).collect()
    assert len(short) == 1 and short[0].field == "columns" and short[0].message.startswith(va.MSG_MISSING_COLUMNS)
    assert va.validate_batch(frame(spark, []), "id", INPUTS, NOMINAL).first().message == va.MSG_EMPTY
    df = frame(spark, [valid() | {"Age": 90, "MonthlyIncome": -1} for _ in range(15)])
    whole = va.validate_batch(df, "id", INPUTS, NOMINAL).collect()
    assert len(whole) == 30 and {r.severity for r in whole} == {"error"}
    cut = va.validate_batch(df, "id", INPUTS, NOMINAL, max_errors=20).orderBy("seq").collect()
    # two errors per row: rows 0..9 reach 20 errors, then the warning
    assert len(cut) == 21 and cut[-1].severity == "warning" and cut[-1].omitted == 10
    assert cut[0].field == "0.Age"
    assert va.validate_batch(frame(spark, [valid()]), "id", INPUTS, NOMINAL, max_errors=20).count() == 0
