"""Sources and sinks (S1–S7): CSV / Parquet / JSON scans and writes, fitted-state
persistence.  Everything is a distributed read or write; nothing is routed
through the driver except the small JSON metadata documents.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.encode import OneHotState, ScalerState
from ..operators.features import FeatureState
from ..session import cut_lineage

# The employee table's declared schema (explicit: no inference pass over the file).
EMPLOYEE_SCHEMA = T.StructType([
    T.StructField(n, t, True) for n, t in [
        ("Age", T.IntegerType()), ("Attrition", T.StringType()), ("BusinessTravel", T.StringType()),
        ("DailyRate", T.IntegerType()), ("Department", T.StringType()),
        ("DistanceFromHome", T.IntegerType()), ("Education", T.IntegerType()),
        ("EducationField", T.StringType()), ("EmployeeCount", T.IntegerType()),
        ("EmployeeNumber", T.LongType()), ("EnvironmentSatisfaction", T.IntegerType()),
        ("Gender", T.StringType()), ("HourlyRate", T.IntegerType()), ("JobInvolvement", T.IntegerType()),
        ("JobLevel", T.IntegerType()), ("JobRole", T.StringType()), ("JobSatisfaction", T.IntegerType()),
        ("MaritalStatus", T.StringType()), ("MonthlyIncome", T.IntegerType()),
        ("MonthlyRate", T.IntegerType()), ("NumCompaniesWorked", T.IntegerType()),
        ("Over18", T.StringType()), ("OverTime", T.StringType()), ("PercentSalaryHike", T.IntegerType()),
        ("PerformanceRating", T.IntegerType()), ("RelationshipSatisfaction", T.IntegerType()),
        ("StandardHours", T.IntegerType()), ("StockOptionLevel", T.IntegerType()),
        ("TotalWorkingYears", T.IntegerType()), ("TrainingTimesLastYear", T.IntegerType()),
        ("WorkLifeBalance", T.IntegerType()), ("YearsAtCompany", T.IntegerType()),
        ("YearsInCurrentRole", T.IntegerType()), ("YearsSinceLastPromotion", T.IntegerType()),
        ("YearsWithCurrManager", T.IntegerType())]])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = EMPLOYEE_SCHEMA,
             mode: str = "FAILFAST") -> DataFrame:
    """S1 (FAILFAST) / S6 (PERMISSIVE: bad lines land in ``_corrupt_record``)."""
    reader = spark.read.option("header", True).option("mode", mode)
    if mode == "PERMISSIVE":
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.schema(schema).csv(path)


MSG_UNPARSEABLE = "Unparseable row: "


def corrupt_rows(df: DataFrame) -> DataFrame:
    """Rows that did not parse, as issues (field, message, severity).  ``df`` is written once, with
    its data columns: Spark refuses to read a file's unparsed lines alone."""
    return (cut_lineage(df).filter(F.col("_corrupt_record").isNotNull())
              .select(F.lit("row").alias("field"),
                      F.concat(F.lit(MSG_UNPARSEABLE), F.col("_corrupt_record")).alias("message"),
                      F.lit("error").alias("severity")))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; selecting columns here prunes the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """S3: overwrite a Parquet table (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with header (one file per partition; no driver collect)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def input_template(df: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """A small template of the input columns."""
    return df.select(*columns).limit(n)


def write_json_doc(spark: SparkSession, doc: dict, path: str) -> None:
    """S4 sink: one small metadata document as a single-line JSON table."""
    spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(path)


def read_json_doc(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """S4 scan of one metadata document, indented or not; a path that does not exist gives
    ``default`` (e.g. threshold 0.5), anything else unreadable is an error."""
    try:
        parts = [r[0] for r in spark.read.text(path, wholetext=True).collect() if r[0].strip()]
    except AnalysisException as e:
        if default is not None and e.getCondition() == "PATH_NOT_FOUND":
            return dict(default)
        raise
    if len(parts) != 1:
        raise ValueError(f"{path} holds {len(parts)} documents, expected one")
    return json.loads(parts[0])


def load_threshold(spark: SparkSession, path: str, default: float = 0.5) -> float:
    return float(read_json_doc(spark, path, {"optimal_threshold": default}).get("optimal_threshold", default))


def models_table(spark: SparkSession, path: str) -> DataFrame:
    """The per-model array of a results document as rows (``explode``)."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("models").alias("m")).select("m.*")


def save_one_hot(state: OneHotState, spark: SparkSession, path: str) -> None:
    """Fitted categories as a Parquet table."""
    state.to_frame(spark).write.mode("overwrite").parquet(path)


def load_one_hot(spark: SparkSession, path: str) -> OneHotState:
    return OneHotState.from_frame(spark.read.parquet(path))


def save_scaler(state: ScalerState, spark: SparkSession, path: str) -> None:
    state.to_frame(spark).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> ScalerState:
    return ScalerState({r["column"]: (r["mean"], r["std"]) for r in spark.read.parquet(path).collect()})


def save_feature_state(state: FeatureState, path: str) -> None:
    """The fitted role medians."""
    state.medians.write.mode("overwrite").parquet(path)


def load_feature_state(spark: SparkSession, path: str, role_col: str = "JobRole",
                       income_col: str = "MonthlyIncome") -> FeatureState:
    medians = spark.read.parquet(path)
    return FeatureState(medians, medians.count(), role_col, income_col)


def save_model(model, path: str) -> None:
    """``PipelineModel`` persistence (encoder stage included)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
