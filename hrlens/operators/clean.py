"""Cleaning: de-duplication, column drops, target checks and target encoding
(Q5, Q6, Q8, Q9, T1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from .profile import assert_no_missing


def handle_duplicates(df: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    """Q5: drop exact duplicates, then repeated ids, keeping the first row per id.

    "First" needs an explicit ingest order (``order_cols``; ties break on all
    columns).  The pick is ``min(struct(order, row))`` per id — an aggregate,
    not a window — so a hot id (say a third of all rows) is reduced map-side
    in every task instead of being sorted inside one task.  ``order_cols`` are
    not part of the row that is returned.
    """
    body = [c for c in df.columns if c not in order_cols]
    key = F.struct(*[col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                   *[col(c).alias(c) for c in body])
    return (df.groupBy(col(id_col).alias("_id")).agg(F.min(key).alias("_r"))
              .select(*[F.col(f"_r.{c}").alias(c) for c in body]))


def drop_uninformative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q6: drop the listed columns that exist (absent names are ignored)."""
    return df.drop(*columns)


def unexpected_labels(df: DataFrame, target: str = "Attrition",
                      allowed: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """Observed target values outside the allowed set (null included), with counts."""
    ok = col(target).isin(list(allowed))
    return (df.filter(~F.coalesce(ok, F.lit(False)))
              .groupBy(col(target).alias(target)).agg(F.count(F.lit(1)).alias("rows"))
              .orderBy(target))


def assert_target_values(df: DataFrame, target: str = "Attrition",
                         allowed: Sequence[str] = ("Yes", "No")) -> None:
    bad = unexpected_labels(df, target, allowed)
    shown = [r[target] for r in bad.limit(20).collect()]
    if shown:
        values, rows = bad.agg(F.count(F.lit(1)), F.sum("rows")).first()
        more = f", {values - len(shown)} more" if values > len(shown) else ""
        raise ValueError(f"{rows} rows have {values} labels outside {sorted(allowed)}: {shown}{more}")


def clean_raw_data(df: DataFrame, drop: Sequence[str], target: str = "Attrition",
                   allowed: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """Q9: Q6 → no-missing check → target check; returns the cleaned frame."""
    out = drop_uninformative(df, drop)
    assert_no_missing(out)
    assert_target_values(out, target, allowed)
    return out


def encode_target(df: DataFrame, target: str = "Attrition", positive: str = "Yes",
                  negative: str = "No", name: str = "Attrition_label",
                  strict: bool = True) -> DataFrame:
    """Yes → 1, No → 0.  ``strict`` fails the job in-plan on any other value."""
    t = col(target)
    mapped = F.when(t == positive, 1).when(t == negative, 0)
    if strict:
        mapped = F.coalesce(mapped, F.raise_error(
            F.lit("A label is neither the positive nor the negative class.")).cast("int"))
    return df.withColumn(name, mapped.cast("int"))
