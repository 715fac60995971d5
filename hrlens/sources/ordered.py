"""Dense row numbers in file order (I3, I5, Q5, Q13) and uploads with unreadable lines.

A table read from files has an order: files by path, rows as they stand in them.  Numbers 1..n follow
it without sorting or gathering rows: a row's place inside its file (Parquet) or inside its part of a
file (text) is known where it is read, and the rows before each file or part are a running sum over one
small row per file or part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col
from ..operators import validate as va
from ..session import cut_lineage
from . import io

BROADCAST_PARTS = 100_000


def _offsets(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys…, _first, _before``: rows before each part, from one row a part (``keys…, _n, _first``)."""
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = cut_lineage(parts.select(*keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return F.broadcast(out) if out.count() <= BROADCAST_PARTS else out


def with_row_numbers(df: DataFrame, name: str = "row_number", file_col: str | None = None) -> DataFrame:
    """``df`` and the row's number, from 1, in file order (and on request its file).  ``df`` is what a
    reader returned: unfiltered, with its files' metadata.

    Parquet rows know their place in the file: a count per file and a join with it.  Rows of other
    files are written once, so that each one's place in its part of a file stays the same.
    """
    known = df.select("_metadata").schema[0].dataType.names
    if "row_index" in known:
        rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
        keys = ["_file"]
        counts = (df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file")
                  .agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("long").alias("_first")))
    else:
        rows = cut_lineage(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"),
                                     F.monotonically_increasing_id().alias("_place")))
        keys = ["_file", "_part"]
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    return (rows.join(_offsets(counts, keys), keys)
            .select(*[col(c) for c in df.columns], *([F.col("_file").alias(file_col)] if file_col else []),
                    (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(name)))


def first_seen(df: DataFrame, columns: Sequence[str], n: int = 5, number: str = "row_number") -> DataFrame:
    """Q13: ``column, seen, value, first_row``: the first ``n`` distinct values of each column in row
    order, as text.  Values are reduced to their first row in every task; the rank filter keeps ``n`` rows
    a column per task before any shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    firsts = (df.select(number, F.explode(pairs).alias("p")).select("p.column", "p.value", number).filter("value is not null")
              .groupBy("column", "value").agg(F.min(number).alias("first_row")))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("first_row"))
    return firsts.withColumn("seen", rank).filter(F.col("seen") <= n).select("column", "seen", "value", "first_row")


def read_upload(spark: SparkSession, path: str, schema: T.StructType = io.EMPLOYEE_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, lines that did not), both with ``row_number`` over all lines of the upload.

    One scan: the lines are written with their numbers and file, and both tables read that.  Rejected
    lines keep ``file, row_number, line``.
    """
    raw = io.read_csv(spark, path, schema, mode="PERMISSIVE")
    lines = cut_lineage(with_row_numbers(raw, file_col="_file_name"))
    bad = F.col("_corrupt_record").isNotNull()
    return (lines.filter(~bad).drop("_corrupt_record", "_file_name"),
            lines.filter(bad).select(F.col("_file_name").alias("file"), "row_number", F.col("_corrupt_record").alias("line")))


def upload_report(rows: DataFrame, rejected: DataFrame, input_columns: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """S6 + I3: one issue table of an upload, unreadable lines (``row_{i}``) beside rule violations
    (``row_{i}.{field}``)."""
    lines = rejected.select(F.concat(F.lit("row_"), F.col("row_number")).alias("field"),
                            F.concat(F.lit(io.MSG_UNPARSEABLE), F.col("line")).alias("message"),
                            F.lit("error").alias("severity"), "row_number")
    broken = va.validation_issues(rows, "row_number", input_columns, nominal).select(
        F.concat(F.lit("row_"), F.col("row_number"), F.lit("."), F.col("field")).alias("field"), "message", "severity", "row_number")
    return lines.unionByName(broken)
