"""Incremental batch scoring over a folder of arriving files.

The reference scores uploaded files one batch at a time; here the same
validation and scoring projections run over a file stream.  Both are
stateless per row, so the stream needs no watermark or state store: the
role-median lookup is a stream-static join and the progress of the file
source is kept in a checkpoint under ``spark.checkpoint.dir`` (shared
storage on a cluster), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as fe
from ..operators import score as sc
from ..operators import validate as va
from ..session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def scored_stream(stream: DataFrame, state: fe.FeatureState, model: sc.LinearModel, id_col: str,
                  input_columns: Sequence[str], nominal: Sequence[str],
                  threshold: float = sc.DEFAULT_THRESHOLD) -> DataFrame:
    """Rows without validation errors are scored (I4–I8); each output row also
    carries its issue count so rejected rows stay visible."""
    checked = stream.withColumn("_issues", F.size(va.issue_array(stream, input_columns, nominal)))
    featured = fe.apply_features(checked, state)
    p = sc.sigmoid(model.logit())
    ok = F.col("_issues") == 0
    return featured.select(
        F.col(id_col).alias("EmployeeID"), F.col("_issues").alias("issues"),
        F.when(ok, F.bround(p, 4)).alias("AttritionProbability"),
        F.when(ok, F.when(p >= threshold, "Yes").otherwise("No")).alias("PredictedAttrition"),
        F.when(ok, sc.risk_tier(p)).alias("RiskTier"),
        F.when(ok, F.bround(sc.confidence(p), 4)).alias("ConfidenceScore"))


def start_scoring(spark: SparkSession, source: str, schema: T.StructType, sink: str, name: str,
                  state: fe.FeatureState, model: sc.LinearModel, id_col: str,
                  input_columns: Sequence[str], nominal: Sequence[str], fmt: str = "parquet",
                  available_now: bool = True):
    """Start the query: file source → validate + score → Parquet sink (exactly-once file sink)."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    out = scored_stream(read_stream(spark, source, schema, fmt), state, model, id_col, input_columns, nominal)
    writer = (out.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
