"""Q2, Q12 and Q15 in a cheap mode: stored sketches per part of a table, merged on read.

``update`` writes one row per (part, column) with exact counts and a HyperLogLog sketch of the distinct
values.  A later part costs a scan of that part only; reports merge the stored rows, so they cost
parts x columns rows however large the table is, and any subset of parts can be asked for.

Distinct counts are estimates with a relative standard error of ``1.04 / sqrt(2 ** LG_K)`` (0.6 %);
small ones are exact but for hash collisions.  A sketch takes up to ``2 ** LG_K`` bytes.

Values are counted as in ``profile.schema_overview``: nulls are left out, numbers and text by value, other
types by their text.  Rows without a part name (null or empty) are a part of their own; a table without rows
adds none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import col

LG_K = 15
LISTED_PARTS = 1000  # up to so many new parts are named in the scan's filter, beyond that they are joined
STORED = "position int, column string, dtype string, rows long, non_null_count long, sketch binary, part string"
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _sketched(c: str, dtype: str) -> Column:
    return F.hll_sketch_agg(col(f"`{c}`").cast("bigint" if dtype in WHOLE else "string"), F.lit(LG_K))


def _key(part: str) -> Column:
    """The part's name; folder names do not tell an empty one from null."""
    name = col(f"`{part}`").cast("string")
    return F.when(name != "", name)


def sketch_parts(df: DataFrame, part: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per (part, column), from one scan whose tasks send one row per part they hold."""
    dtypes = [(i, c, t) for i, (c, t) in enumerate(df.dtypes) if columns is None or c in columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c, t in dtypes:
        aggs += [F.count(col(f"`{c}`")).alias(f"n{i}"), _sketched(c, t).alias(f"s{i}")]
    wide = df.groupBy(_key(part).alias("part")).agg(*aggs)
    per = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), "rows",
                             F.col(f"n{i}").alias("non_null_count"), F.col(f"s{i}").alias("sketch")) for i, c, t in dtypes])
    return wide.select("part", F.explode(per).alias("p")).select("p.*", "part")


def stored(spark: SparkSession, path: str, parts: Sequence[str | None] | None = None) -> DataFrame:
    """The sketches below ``path``; ``parts`` prunes folders."""
    found = spark.read.schema(STORED).parquet(path)
    if parts is None:
        return found
    named = F.col("part").isin([p for p in parts if p is not None])
    return found.filter(named | F.col("part").isNull() if None in parts else named)


def _new_parts(df: DataFrame, part: str, held: DataFrame) -> DataFrame:
    """The rows of ``df`` whose part has no sketch yet; only the part column is read to find these."""
    held = held.select(F.col("part").alias("held")).distinct()
    new = df.select(_key(part).alias("new")).distinct().join(held, F.col("new").eqNullSafe(F.col("held")), "left_anti")
    names = [r["new"] for r in new.limit(LISTED_PARTS + 1).collect()]
    if len(names) > LISTED_PARTS:
        return df.join(new, _key(part).eqNullSafe(F.col("new")), "left_semi")
    # on the column itself, so that the filter reaches the scan
    named = col(f"`{part}`").isin([F.lit(x).cast(df.schema[part].dataType) for x in names if x is not None])
    return df.filter(named | _key(part).isNull() if None in names else named)


def update(df: DataFrame, part: str, path: str, columns: Sequence[str] | None = None, again: bool = False) -> None:
    """Sketch the parts of ``df`` that are not stored below ``path`` yet (``again``: all its parts, taking the
    place of stored ones).  A part is taken as complete: all its rows are in ``df``."""
    try:
        rows = df if again else _new_parts(df, part, stored(df.sparkSession, path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = df
    (sketch_parts(rows, part, columns).repartition("part").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path))


def merged(sketches: DataFrame) -> DataFrame:
    """``position, column, dtype, rows, non_null_count, unique_values`` over all given parts.  Where parts
    differ in a column's position or type, the first part by name that holds the column decides."""
    first = F.min_by(F.struct("position", "dtype"), F.struct(F.coalesce("part", F.lit("")), "position", "dtype"))
    distinct = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return (sketches.groupBy("column")
            .agg(first.alias("at"), F.sum("rows").alias("rows"), F.sum("non_null_count").alias("non_null_count"), distinct.alias("unique_values"))
            .select("at.position", "column", "at.dtype", "rows", "non_null_count", F.least("unique_values", "non_null_count").alias("unique_values")))


def schema_overview(spark: SparkSession, path: str, parts: Sequence[str | None] | None = None) -> DataFrame:
    """Q2 from stored sketches."""
    return merged(stored(spark, path, parts)).drop("rows").orderBy("position")


def cardinality_ranking(spark: SparkSession, path: str, columns: Sequence[str], parts: Sequence[str | None] | None = None) -> DataFrame:
    """Q12 from stored sketches: distinct values of the named columns, most first."""
    return (merged(stored(spark, path, parts).filter(F.col("column").isin(list(columns))))
            .select("column", "unique_values").orderBy(F.desc("unique_values"), "column"))


def column_groups(spark: SparkSession, path: str, groups: dict[str, list[str]], parts: Sequence[str | None] | None = None) -> DataFrame:
    """Q15 from stored sketches: domain group to column with dtype and distinct count; a column without
    sketch has neither."""
    named = spark.createDataFrame([(g, c) for g, cols in groups.items() for c in cols], "group string, column string")
    return (named.join(schema_overview(spark, path, parts), "column", "left")
            .select("group", "column", "dtype", "unique_values").orderBy("group", "column"))
