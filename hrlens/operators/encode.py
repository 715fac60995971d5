"""Categorical encoding and scaling with fit-on-train / apply-everywhere state
(T2–T6).

Fitting computes small tables (sorted categories per column, mean and
population std per column) from the training rows only; applying is a single
projection, so encoding never shuffles.  The category list defines output
columns, so it is collected to the driver; its size is checked against
``max_categories`` (a wide one-hot is bounded by the schema it produces).
Models that meet wider columns take ``vector_encoder`` (StringIndexer and
OneHotEncoder: one sparse vector column whatever the number of categories).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, lit_d
from ..session import cut_lineage


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail with the list of absent columns (driver-side set difference)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"The table has no columns {missing}")


@dataclass
class OneHotState:
    """Sorted categories per nominal column; the first of each is dropped."""
    categories: dict[str, list[str]]

    def output_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.categories.items() for v in vals[1:]]

    def to_frame(self, spark) -> DataFrame:
        rows = [(c, i, v) for c, vals in self.categories.items() for i, v in enumerate(vals)]
        return spark.createDataFrame(rows, "column string, position int, category string")

    @staticmethod
    def from_frame(df: DataFrame) -> "OneHotState":
        cats: dict[str, list[str]] = {}
        for r in df.orderBy("column", "position").collect():
            cats.setdefault(r["column"], []).append(r["category"])
        return OneHotState(cats)


def fit_one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = 10_000) -> OneHotState:
    """T3 fit: distinct non-null categories per column (one shuffle of distinct pairs)."""
    require_columns(df, columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("category")) for c in columns
    ])).alias("k")).select("k.*").filter(F.col("category").isNotNull()).distinct()
    n = long.count()
    if n > max_categories:
        raise ValueError(f"{n} categories would become as many columns (max_categories={max_categories}); "
                         "use vector_encoder for such columns")
    cats: dict[str, list[str]] = {c: [] for c in columns}
    for r in long.collect():
        cats[r["column"]].append(r["category"])
    return OneHotState({c: sorted(v) for c, v in cats.items()})


def _merged(parts: Sequence[tuple[int, float | None, float | None]]) -> tuple[float | None, float | None]:
    """Mean and population std of several groups from their (count, mean, population variance)."""
    n, mean, m2 = 0, 0.0, 0.0
    for k, m, v in parts:
        if k:
            delta = m - mean
            n, m2 = n + k, m2 + v * k + delta * delta * n * k / (n + k)
            mean += delta * k / n
    return (mean, math.sqrt(max(m2, 0.0) / n) if m2 == m2 else m2) if n else (None, None)


def fit_encoders(train: DataFrame, nominal: Sequence[str], numeric: Sequence[str], folds: Sequence[int | None], scale: Sequence[str] = (),
                 fold_col: str = "fold", max_categories: int = 10_000) -> dict[int | None, tuple["EncoderState", "EncoderState"]]:
    """For each fold the two ``fit_encoder(..., impute=True)`` of the rows outside of it (None: of all rows), without and
    with ``scale``: from one aggregate per fold and one shuffle of distinct categories for all of them."""
    require_columns(train, [*nominal, *numeric])
    aggs = []
    for i, c in enumerate(numeric):
        x, y = col(c).cast("double"), missing_or(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"),
                 F.count(y).alias(f"k{i}"), F.avg(y).alias(f"a{i}")]
    moments = train.groupBy(F.col(fold_col).alias("fold")).agg(F.count(F.lit(1)).alias("n"), *aggs).collect()     # one row per fold
    long = train.select(F.col(fold_col).alias("fold"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("category")) for c in nominal
    ])).alias("k")).select("fold", "k.*").filter(F.col("category").isNotNull()).distinct() if nominal else None
    found: list = []
    if long is not None:
        long = cut_lineage(long)
        n = long.select("column", "category").distinct().count()
        if n > max_categories:
            raise ValueError(f"{n} categories would become as many columns (max_categories={max_categories}); "
                             "use vector_encoder for such columns")
        found = long.collect()
    out = {}
    for f in folds:
        inside = [r for r in moments if f is None or (r["fold"] is not None and r["fold"] != f)]
        cats: dict[str, set[str]] = {c: set() for c in nominal}
        for r in found:
            if f is None or (r["fold"] is not None and r["fold"] != f):
                cats[r["column"]].add(r["category"])
        hot = OneHotState({c: sorted(v) for c, v in cats.items()})
        scaler, fill = {}, {}
        for i, c in enumerate(numeric):
            if c in scale:
                scaler[c] = _merged([(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in inside])
            if sum(r["n"] - r[f"k{i}"] for r in inside):
                fill[c] = _merged([(r[f"k{i}"], r[f"a{i}"], 0.0) for r in inside])[0] or 0.0
        out[f] = (EncoderState(hot, None, list(numeric), fill),
                  EncoderState(hot, ScalerState(scaler) if scaler else None, [c for c in numeric if c not in scale], dict(fill)))
    return out


def vector_encoder(columns: Sequence[str], output: str = "nominal_vector") -> Pipeline:
    """T3 for any cardinality: an unfitted pipeline to one sparse vector, the smallest category of each
    column dropped; unknown and null values go to a slot of their own."""
    idx = [f"{c}__idx" for c in columns]
    hot = [f"{c}__hot" for c in columns]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(columns), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=hot, outputCol=output)])


def one_hot_columns(state: OneHotState) -> list[Column]:
    """T3 apply: ``col_cat`` doubles; unknown and null encode as all zeros (drop='first')."""
    return [F.coalesce(col(c) == F.lit(v), F.lit(False)).cast("double").alias(f"{c}_{v}")
            for c, vals in state.categories.items() for v in vals[1:]]


@dataclass
class ScalerState:
    """Per-column mean and population std (std 0 → scale 1, like sklearn)."""
    moments: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, m, s) for c, (m, s) in self.moments.items()],
                                     "column string, mean double, std double")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> ScalerState:
    """T4 fit: one aggregate pass (nulls ignored), population std."""
    require_columns(df, columns)
    aggs = []
    for c in columns:
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return ScalerState({c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns})


def scaled_columns(state: ScalerState) -> list[Column]:
    out = []
    for c, (m, s) in state.moments.items():
        scale = 1.0 if (s is None or s == 0.0) else s
        out.append(((col(c).cast("double") - lit_d(m if m is not None else 0.0)) / lit_d(scale)).alias(c))
    return out


@dataclass
class EncoderState:
    """``fill``: numeric column → value for missing entries (the train mean); every such column also has a 0/1
    indicator.  Without ``fill`` nulls stay null (T5)."""
    nominal: OneHotState
    scaler: ScalerState | None
    passthrough: list[str]
    fill: dict[str, float] = field(default_factory=dict)

    def output_names(self) -> list[str]:
        scaled = list(self.scaler.moments) if self.scaler else []
        return self.nominal.output_names() + scaled + self.passthrough + [f"{c}_missing" for c in self.fill]


def missing_or(c: str) -> Column:
    """The value as a double; null and NaN are missing."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def fit_fill(train: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Train mean of every numeric column that has a missing entry in train (0 if all are missing)."""
    row = train.agg(*[F.avg(missing_or(c)).alias(f"m{i}") for i, c in enumerate(numeric)],
                    *[F.count_if(missing_or(c).isNull()).alias(f"n{i}") for i, c in enumerate(numeric)]).first()
    return {c: row[f"m{i}"] or 0.0 for i, c in enumerate(numeric) if row[f"n{i}"]}


def fit_encoder(train: DataFrame, nominal: Sequence[str], numeric: Sequence[str],
                scale: Sequence[str] | None = None, impute: bool = False) -> EncoderState:
    """T5 fit: one-hot on ``nominal``; ``scale`` (subset of numeric) standardised; rest passthrough.
    ``impute`` learns the null policy of the models (mean and indicator)."""
    scale = [c for c in (scale or []) if c in numeric]
    return EncoderState(fit_one_hot(train, nominal),
                        fit_scaler(train, scale) if scale else None,
                        [c for c in numeric if c not in scale], fit_fill(train, numeric) if impute else {})


def transform_features(df: DataFrame, state: EncoderState, keep: Sequence[str] = ()) -> DataFrame:
    """T5/T6 apply: ``keep`` columns (id, target, label…), then one-hots, scaled, passthrough."""
    if state.fill:
        df = df.withColumns({f"{c}_missing": missing_or(c).isNull().cast("double") for c in state.fill})
        df = df.withColumns({c: F.coalesce(missing_or(c), lit_d(v)) for c, v in state.fill.items()})
    cols = [col(k) for k in keep] + one_hot_columns(state.nominal)
    if state.scaler:
        cols += scaled_columns(state.scaler)
    cols += [col(c).cast("double").alias(c) for c in state.passthrough]
    cols += [F.col(f"{c}_missing") for c in state.fill]
    return df.select(*cols)
