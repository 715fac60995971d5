"""Table profiling and data-quality checks (Q1–Q13).

Pattern: stack the columns once into a long ``(column, value)`` table and
aggregate it with a single shuffle keyed by column (or column, value).  This
avoids one scan per column and the row-multiplying Expand that many
``count(distinct)`` aggregates in one ``agg`` would produce.

Quantiles are exact and come from value counts and running sums
(``operators.quantile``); no column's values are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col, is_missing, lit_d, r
from .quantile import quantiles, value_counts

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def long_table(df: DataFrame, columns: Sequence[str], value_type: str = "string",
               keep: Sequence[str] = ()) -> DataFrame:
    """Stack ``columns`` into ``(column, value)`` (value cast to ``value_type``)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast(value_type).alias("value"))
                      for c in columns])
    return (df.select(*keep, F.explode(pairs).alias("_kv"))
              .select(*keep, "_kv.column", "_kv.value"))


def duplicate_rows(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows that repeat an earlier full row (pandas ``duplicated().sum()``, nulls equal).

    ``groupBy(all columns)`` pre-aggregates map-side, so a heavily repeated
    row collapses before the shuffle.
    """
    cols = [c for c in df.columns if c not in exclude]
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
              .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Q1: one row per column (position, column, dtype, missing) with the table's rows, columns, total
    missing cells and duplicate rows beside it.

    Everything comes from the table reduced to its distinct rows and their counts: one shuffle, one
    scan, and a row that holds a third of the table is one row per task.
    """
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    wide = groups.agg(F.coalesce(F.sum("_n"), zero).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), zero).alias("duplicate_rows"),
                      *[F.coalesce(F.sum(F.when(is_missing(c, t), F.col("_n"))), zero).alias(f"_m{i}") for i, (c, t) in enumerate(types.items())])
    per = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"_m{i}").alias("missing"))
                    for i, (c, t) in enumerate(df.dtypes)])
    total = sum((F.col(f"_m{i}") for i in range(len(types))), zero)
    return wide.select("rows", "duplicate_rows", total.alias("missing_values"), F.explode(per).alias("p")).select(
        "p.*", "rows", F.lit(len(types)).alias("columns"), "missing_values", "duplicate_rows")


def schema_overview(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q2: dtype, non-null count and distinct count per column (one shuffle)."""
    dtypes = df.sparkSession.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, column string, dtype string")
    distinct = F.approx_count_distinct("value") if approx else F.count_distinct("value")
    stats = (long_table(df, df.columns).groupBy("column")
             .agg(F.count("value").alias("non_null_count"), distinct.alias("unique_values")))
    return dtypes.join(stats, "column", "left").orderBy("position")


def missing_report(df: DataFrame) -> DataFrame:
    """Q3: missing (null, and NaN for floats) per column where > 0, count desc."""
    aggs = [F.sum(is_missing(f.name, f.dataType.typeName()).cast("long")).alias(f.name)
            for f in df.schema.fields]
    wide = df.agg(*aggs)
    return (wide.unpivot([], df.columns, "column", "missing")
            .filter(F.col("missing") > 0).orderBy(F.desc("missing"), "column"))


def assert_no_missing(df: DataFrame) -> None:
    """``validate_no_missing_values``: raise listing columns with nulls."""
    bad = {r_["column"]: r_["missing"] for r_ in missing_report(df).collect()}
    if bad:
        raise ValueError(f"Columns with missing values (and how many): {bad}")


def duplicate_report(df: DataFrame, id_col: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Q4: full-row duplicates and id collisions (a null id is one value)."""
    ids = df.agg((F.count(F.lit(1)) - F.count_distinct(col(id_col))
                  - F.coalesce(F.max(col(id_col).isNull().cast("int")), F.lit(0))).cast("long").alias("duplicate_ids"))
    return duplicate_rows(df, exclude).crossJoin(ids)


def constant_columns(df: DataFrame) -> DataFrame:
    """Q7: columns with exactly one distinct non-null value, and that value.

    "One distinct non-null value" is ``min == max`` over the non-null values,
    so this is a single aggregate pass, reduced map-side, with no shuffle of
    distinct values.  The value is compared in the column's own type, then
    shown as text (a floating number with six decimals).
    """
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}")]
    row = df.agg(*aggs)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(f"lo{i}") == F.col(f"hi{i}")).alias("const"),
                 (F.col(f"lo{i}").try_cast("decimal(38, 6)") if t in ("double", "float") else F.col(f"lo{i}"))
                 .cast("string").alias("value"))
        for i, (c, t) in enumerate(df.dtypes)])
    return (row.select(F.explode(pairs).alias("p")).select("p.*")
               .filter(F.coalesce(F.col("const"), F.lit(False)))
               .select("column", "value").orderBy("column"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Q10: IQR fences and outlier counts per numeric column (absent columns skipped), all from the
    value counts per column.  ``outlier_pct`` is over all rows."""
    cols = [c for c in columns if c in df.columns]
    counts = value_counts(df, cols, missing=True)
    present = counts.filter(F.col("value").isNotNull())
    m = lit_d(multiplier)
    q1, q3 = F.col("q1"), F.col("q3")
    fences = quantiles(present, ["column"], [0.25, 0.75]).select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).select(
        "*", (q1 - m * (q3 - q1)).alias("iqr_lower"), (q3 + m * (q3 - q1)).alias("iqr_upper"))
    x = F.col("value")
    out = (x < F.col("iqr_lower")) | (x > F.col("iqr_upper"))
    return (counts.join(fences, "column").groupBy("column", "q1", "q3", "iqr_lower", "iqr_upper")
            .agg(F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("unique_values"),
                 F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).cast("long").alias("outlier_count"), F.sum("n").alias("_rows"))
            .select("column", "min", "max", "q1", "q3", r("iqr_lower").alias("iqr_lower"),
                    r("iqr_upper").alias("iqr_upper"), "outlier_count",
                    F.bround(F.col("outlier_count") * lit_d(100.0) / F.col("_rows"), 2).alias("outlier_pct"),
                    "unique_values")
            .orderBy("column"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q11: ``describe().T`` — count, mean, sample std, min, quartiles, max per column."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    counts = value_counts(df, cols)
    v, n = F.col("value"), F.col("n")
    mean = counts.groupBy("column").agg(F.sum("n").alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    spread = counts.join(mean.select("column", "mean"), "column").groupBy("column").agg(
        F.sum((v - F.col("mean")) ** 2 * n).alias("ss"))
    q = quantiles(counts, ["column"], [0.25, 0.5, 0.75])
    return (mean.join(spread, "column").join(q, "column")
            .select("column", "count", r("mean").alias("mean"),
                    r(F.sqrt(F.try_divide(F.col("ss"), (F.col("count") - 1).cast("double")))).alias("std"), "min",
                    F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
            .orderBy("column"))


def category_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q12: value counts per categorical column (long form)."""
    cols = list(columns) if columns is not None else string_columns(df)
    return (long_table(df, cols).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("column", F.desc("count"), "value"))


def cardinality_ranking(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q12: distinct values per categorical column, most first."""
    cols = list(columns) if columns is not None else string_columns(df)
    return (long_table(df, cols).groupBy("column")
            .agg(F.count_distinct("value").alias("unique_values"))
            .orderBy(F.desc("unique_values"), "column"))


def column_verification(df: DataFrame, small: int = 10, show: int = 5) -> DataFrame:
    """Q13: dtype, distinct count and a sample per column.

    ≤ ``small`` distinct → the ``show`` smallest values; numeric → ``[min, ..., max]``;
    string → the two most frequent ``value: count`` (ties by value).  The
    reference's "first seen" becomes "smallest" (a table has no row order).
    Only columns already known to be small are windowed; the top-2 for wide
    string columns comes from two partial-aggregating ``max`` passes.
    """
    spark = df.sparkSession
    num = set(numeric_columns(df))
    meta = spark.createDataFrame([(i, n, t, n in num) for i, (n, t) in enumerate(df.dtypes)],
                                 "position int, column string, dtype string, is_num boolean")
    nums, strs = [c for c in df.columns if c in num], [c for c in df.columns if c not in num]
    parts = []
    if nums:
        parts.append(long_table(df, nums, "double").select("column", F.lit(None).cast("string").alias("s"),
                                                           F.col("value").alias("d")))
    if strs:
        parts.append(long_table(df, strs).select("column", F.col("value").alias("s"),
                                                 F.lit(None).cast("double").alias("d")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.filter(F.col("s").isNotNull() | F.col("d").isNotNull())
    vc = long.groupBy("column", "s", "d").agg(F.count(F.lit(1)).alias("n"))
    per = vc.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"), F.min("d").alias("dmin"), F.max("d").alias("dmax"),
        F.min(F.struct((-F.col("n")).alias("k"), F.col("s").alias("s"))).alias("top1"))
    small_cols = per.filter(F.col("unique_values") <= small).select("column")
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy("d", "s")
    smallest = (vc.join(small_cols, "column")
                .withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= show)
                .groupBy("column")
                .agg(F.array_sort(F.collect_list(F.struct("_rk", F.coalesce(
                    F.col("s"), F.regexp_replace(F.col("d").cast("string"), r"\.0$", ""))
                    .alias("v")))).alias("_vals"))
                .select("column", F.concat(F.lit("["), F.array_join(F.col("_vals.v"), ", "),
                                           F.lit("]")).alias("small_sample")))
    top1 = per.select("column", F.col("top1.s").alias("t1"), (-F.col("top1.k")).alias("n1"))
    second = (vc.filter(F.col("s").isNotNull()).join(top1, "column")
              .filter(F.col("s") != F.col("t1"))
              .groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("s").alias("s"))).alias("top2")))

    def fmt_num(c: str) -> Column:
        return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")

    out = (meta.join(per, "column", "left").join(smallest, "column", "left")
           .join(top1, "column", "left").join(second, "column", "left"))
    sample = (F.when(F.col("unique_values") <= small, F.col("small_sample"))
              .when(F.col("is_num"), F.concat(F.lit("["), fmt_num("dmin"), F.lit(", ..., "),
                                              fmt_num("dmax"), F.lit("]")))
              .otherwise(F.concat_ws(", ", F.concat(F.col("t1"), F.lit(": "), F.col("n1").cast("string")),
                                     F.concat(F.col("top2.s"), F.lit(": "),
                                              (-F.col("top2.k")).cast("string")))))
    return out.select("position", "column", "dtype",
                      F.coalesce("unique_values", F.lit(0)).cast("long").alias("unique_values"),
                      sample.alias("sample_values")).orderBy("position")


def schema_check(df: DataFrame, registry: dict[str, str]) -> DataFrame:
    """Q14: registry (column → role) against the table's schema (full outer join):
    status is ``ok``, ``missing`` (registered, absent) or ``unregistered``."""
    spark = df.sparkSession
    reg = spark.createDataFrame(list(registry.items()), "column string, role string")
    actual = spark.createDataFrame(list(df.dtypes), "column string, dtype string")
    return (reg.join(actual, "column", "full")
               .select("column", "role", "dtype",
                       F.when(F.col("dtype").isNull(), "missing").when(F.col("role").isNull(), "unregistered")
                        .otherwise("ok").alias("status"))
               .orderBy("column"))


class FeatureSpec(NamedTuple):
    """What is registered about a column; ``lower`` and ``upper`` bound its numbers, ``values`` lists its
    texts (``|`` between them)."""

    column: str
    kind: str
    description: str
    action: str
    justification: str
    lower: float | None = None
    upper: float | None = None
    values: str | None = None


def feature_registry(df: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """Q14: the registry beside what the table holds: type, missing cells, numeric range, cells outside the
    registered bounds or values, and a status: ``missing`` (registered, absent), ``unregistered``,
    ``constant`` (one value, though not registered as such), ``outside`` (some cells are) or ``ok``.

    All figures come from one aggregate pass.  The registry's text is as long as the table is wide.
    """
    spark = df.sparkSession
    spec_of = {s.column: s for s in specs}
    num = set(numeric_columns(df))
    zero = F.lit(0).cast("long")
    aggs = []
    for i, (c, t) in enumerate(df.dtypes):
        x, s = col(f"`{c}`"), spec_of.get(c)
        x = F.when(~is_missing(x, t), x)
        outside = F.lit(False)
        if s is not None and c in num:
            outside = (x < lit_d(s.lower) if s.lower is not None else outside) | (x > lit_d(s.upper) if s.upper is not None else outside)
        elif s is not None and s.values is not None:
            outside = ~x.isin(s.values.split("|"))
        aggs += [F.coalesce(F.sum(x.isNull().cast("long")), zero).alias(f"m{i}"), (F.min(x) == F.max(x)).alias(f"c{i}"),
                 *[(f(x) if c in num else F.lit(None)).cast("double").alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max))],
                 F.coalesce(F.sum(F.when(outside, 1)), zero).cast("long").alias(f"o{i}")]
    per = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"m{i}").alias("missing"), F.col(f"lo{i}").alias("min"),
                             F.col(f"hi{i}").alias("max"), F.col(f"o{i}").alias("outside"), F.col(f"c{i}").alias("constant"))
                    for i, (c, t) in enumerate(df.dtypes)])
    held = df.agg(*aggs).select(F.explode(per).alias("p")).select("p.*")
    registry = spark.createDataFrame([s[:5] for s in specs],
                                     "column string, kind string, description string, action string, justification string")
    status = (F.when(F.col("dtype").isNull(), "missing").when(F.col("kind").isNull(), "unregistered")
              .when(F.col("constant") & (F.col("kind") != "constant"), "constant").when(F.col("outside") > 0, "outside").otherwise("ok"))
    return (registry.join(held, "column", "full")
            .select("column", "kind", "description", "action", "justification", "dtype", "missing", "min", "max", "outside", status.alias("status"))
            .orderBy("column"))


def column_groups(df: DataFrame, groups: dict[str, list[str]], approx: bool = False) -> DataFrame:
    """Q15: domain group → column with dtype and distinct count (joined to Q2)."""
    spark = df.sparkSession
    g = spark.createDataFrame([(grp, c) for grp, cols in groups.items() for c in cols],
                              "group string, column string")
    named = [c for c in df.columns if any(c in cols for cols in groups.values())]
    return (g.join(schema_overview(df.select(*named), approx).select("column", "dtype", "unique_values"), "column", "left")
             .select("group", "column", "dtype", "unique_values").orderBy("group", "column"))
