"""Exact quantiles from counts per value, with no group gathered in one task.

``value_counts`` reduces the table to one row per (group, column, value), a partial aggregate.
``quantiles`` finds the needed ranks by running sums over value buckets: counts per bucket first
(at most ``BUCKETS`` rows per group), then inside the one bucket that holds a rank.  Values are
bucketed at cut points taken from the data, so a bucket stays small wherever the values lie.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, lit_d
from ..session import cut_lineage

BUCKETS = 1024


def bucketed(df: DataFrame, column: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the number of the bucket that a double falls in.  The cut points are approximate
    quantiles of the column itself, ``buckets - 1`` numbers on the driver."""
    grid = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))  # one text: cheaper than as many Column objects
    cuts = df.agg(F.expr(f"percentile_approx(`{column}`, array({grid}), {10 * buckets})").alias("c")).first()["c"] or []
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    if len(splits) < 3:
        return df.withColumn(name, lit_d(0.0))
    return Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), missing: bool = False) -> DataFrame:
    """``by…, column, value, n`` of the present (not null, not NaN) values, as doubles; ``missing``
    adds a row with a null value per column that has missing entries.

    The counts are checkpointed: everything that follows reads them instead of the table.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.column", "p.value")
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if not missing:
        long = long.filter(F.col("value").isNotNull())
    return cut_lineage(long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def quantiles(counts: DataFrame, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """``by…, q``: the interpolated quantiles ``at`` (sorted) of each group of value counts."""
    by = list(by)
    counts = bucketed(counts, "value", "_b")
    sums = counts.groupBy(*by, "_b").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                       F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    # the two ranks (from 0) around each quantile
    spot = [lit_d(q) * (F.col("_total") - 1) for q in at]
    ranks = F.array(*[x for s in spot for x in (F.floor(s), F.ceil(s))])
    wanted = F.filter(F.array_distinct(ranks), lambda x: (x >= F.col("_start")) & (x < F.col("_start") + F.col("_n")))
    sums = sums.withColumn("_want", wanted).filter(F.size("_want") > 0)
    on = [*by, "_b"]
    inner = Window.partitionBy(*on).orderBy("value")
    inside = counts.join(sums, on).withColumn("_upto", F.col("_start") + F.sum("n").over(inner))
    hit = inside.select(*by, "_total", "value", F.explode(F.filter("_want", lambda x: (x >= F.col("_upto") - F.col("n")) & (x < F.col("_upto")))).alias("_rank"))
    found = hit.groupBy(*by).agg(F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_at"))
    lows = [F.element_at("_at", F.floor(s)) for s in spot]
    highs = [F.element_at("_at", F.ceil(s)) for s in spot]
    return found.select(*by, F.array(*[a + (b - a) * (s - F.floor(s)) for a, b, s in zip(lows, highs, spot)]).alias("q"))
