"""End-to-end compositions (T7, L11, M15) over the operators and the scoring path from raw rows.

Intermediate tables that several steps read are checkpointed in the shared folder (nothing is left
cached); stage outputs are written as Parquet, JSON and ``PipelineModel`` folders when an output
folder is given, as the reference's stages talk through files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import correlation as corr
from ..operators import encode as enc
from ..operators import features as fe
from ..operators import metrics as mt
from ..operators import profile as pf
from ..operators import score as sc
from ..operators import split as sp
from ..session import cut_lineage, written
from ..sources import io
from . import modeling as ml


def run_preprocessing(df: DataFrame, id_col: str, order_cols: Sequence[str], drop: Sequence[str],
                      nominal: Sequence[str], numeric: Sequence[str], scale: Sequence[str] = (),
                      target: str = "Attrition", positive: str = "Yes", negative: str = "No",
                      out_dir: str | None = None) -> tuple[DataFrame, dict]:
    """Q5 → Q3 → Q6 → Q8 → Q10 → T1 → T5 → T6 (→ S3)."""
    n_in = len(df.columns)
    dedup = cut_lineage(cl.handle_duplicates(df, id_col, order_cols))
    dup = pf.duplicate_report(df.drop(*order_cols), id_col).first().asDict()
    missing = {r["column"]: r["missing"] for r in pf.missing_report(dedup).collect()}
    cleaned = cl.drop_uninformative(dedup, drop)
    cl.assert_target_values(cleaned, target, (positive, negative))
    outliers = pf.iqr_outliers(cleaned, list(numeric))
    labelled = cl.encode_target(cleaned, target, positive, negative)
    state = enc.fit_encoder(labelled, nominal, numeric, scale=list(scale) or None)
    pre = enc.transform_features(labelled, state, keep=[id_col, target, "Attrition_label"])
    if out_dir:
        io.write_parquet(cleaned, f"{out_dir}/cleaned")
        io.write_parquet(pre, f"{out_dir}/preprocessed")
        io.save_one_hot(state.nominal, df.sparkSession, f"{out_dir}/state/categories")
        if state.scaler:
            io.save_scaler(state.scaler, df.sparkSession, f"{out_dir}/state/scaler")
    rows = dedup.count()
    report = {"input_columns": n_in, "rows_after_dedup": rows, "duplicates": dup, "missing": missing,
              "dropped_columns": [c for c in drop if c in df.columns],
              "cleaned_columns": len(cleaned.columns), "preprocessed_columns": len(pre.columns),
              "outliers": [r.asDict() for r in outliers.collect()],
              "output_features": state.output_names()}
    return pre, report


def run_feature_engineering(df: DataFrame, id_col: str, nominal: Sequence[str], numeric: Sequence[str],
                            target: str = "Attrition", positive: str = "Yes",
                            threshold: float = fe.CORRELATION_THRESHOLD, seed: int = 42,
                            num_trees: int = 300, max_depth: int = 30,
                            out_dir: str | None = None) -> dict:
    """X1 → A1 (train) → T16 (all rows) → L9 + A10 (train) → L10 → selection.

    Train and test stay in one table with a ``split`` column (U1 is then a no-op).
    """
    spark = df.sparkSession
    lab = df.withColumn("label", F.when(F.col(target) == positive, 1).otherwise(0))
    split = cut_lineage(sp.stratified_split(lab, "label", [id_col], seed=seed))
    state = fe.fit_feature_state(split.filter(F.col("split") == "train"))
    featured = cut_lineage(fe.apply_features(split, state))
    ftrain = featured.filter(F.col("split") == "train")
    candidates = list(numeric) + fe.ENGINEERED
    imp = ml.rf_importance(ftrain, nominal, candidates, "label", num_trees, max_depth, seed)
    pairs = written(corr.redundant_pairs(ftrain, candidates, threshold), "redundant")
    # one row per dropped feature at most
    decisions = [r.asDict() for r in corr.resolve_redundancy(pairs, imp).collect()]
    dropped = [d["dropped_feature"] for d in decisions]
    selected = [c for c in list(nominal) + candidates if c not in dropped]
    if out_dir:
        io.write_parquet(featured, f"{out_dir}/featured", partition_by=["split"])
        io.save_feature_state(state, f"{out_dir}/state/role_medians")
        io.write_json_doc(spark, {"selected_features": selected, "dropped_features": dropped, "nominal": list(nominal),
                                  "base_features": list(nominal) + list(numeric), "decisions": decisions},
                          f"{out_dir}/selected_features")
    return {"featured": featured, "importance": imp, "pairs": pairs, "decisions": decisions, "dropped": dropped,
            "selected": selected, "state": state}


def decisions_table(spark: SparkSession, decisions: list[dict]) -> DataFrame:
    """The redundancy decisions as rows."""
    names = ["dropped_feature", "kept_feature", "correlation", "dropped_importance", "kept_importance", "reason"]
    return spark.createDataFrame([tuple(d[c] for c in names) for d in decisions],
                                 "dropped_feature string, kept_feature string, correlation double, "
                                 "dropped_importance double, kept_importance double, reason string")


def run_evaluation(features: dict, nominal: Sequence[str], id_col: str, folds: int = 5, full_grid: bool = True,
                   models: Sequence[str] | None = None, method: str = "f1", seed: int = 42,
                   out_dir: str | None = None) -> dict:
    """L8 + M15 on the features that L11 selected: train, score every row once, compare, choose the
    winner by unrounded metrics, search its threshold on the X3 carve-out of train, save all."""
    table = features["featured"]
    spark = table.sparkSession
    numeric = [c for c in features["selected"] if c not in nominal]
    kept_nominal = [c for c in features["selected"] if c in nominal]
    trained, scores = ml.run_training(table, kept_nominal, numeric, id_col, folds=folds, full_grid=full_grid,
                                      models=models, seed=seed)
    comparison = cut_lineage(ml.comparison_table(scores, trained))
    winner = mt.best_model(comparison.drop("roc_auc_gap"), comparison.select("model", "roc_auc_gap")).first()
    carve = sp.stratified_split(table.filter("split = 'train'").select(id_col, "label"), "label", [id_col], seed=seed + 1)
    valid = carve.filter("split = 'test'").select(F.col(id_col).alias("id"))
    tuned = mt.optimal_threshold(scores.filter((F.col("model") == winner["model"]) & (F.col("split") == "train"))
                                 .join(valid, "id", "left_semi"), method=method).first()
    result = {"trained": trained, "scores": scores, "comparison": comparison, "best_model": winner["model"],
              "rationale": winner["rationale"], "threshold": tuned["threshold"], "threshold_metrics": tuned.asDict()}
    if out_dir:
        io.write_parquet(scores, f"{out_dir}/scores", partition_by=["split"])
        io.write_parquet(comparison, f"{out_dir}/comparison")
        for t in trained:
            io.save_model(t.model, f"{out_dir}/models/{t.name}")
        test = scores.filter((F.col("split") == "test") & (F.col("model") == winner["model"]))
        n, rate = test.agg(F.count(F.lit(1)), F.avg("y")).first()
        io.write_json_doc(spark, {"best_model": winner["model"], "selection_rationale": winner["rationale"], "n_test": n,
                                  "positive_rate": rate, "optimal_threshold": tuned["threshold"],
                                  "threshold_optimization": {"method": method, **tuned.asDict()},
                                  "models": [r.asDict() for r in comparison.orderBy("model").collect()]},
                          f"{out_dir}/evaluation_results")
    return result


@dataclass
class Bundle:
    """What scoring needs: saved selection, feature state, winning model and threshold."""
    selection: dict
    state: fe.FeatureState
    model: PipelineModel
    threshold: float

    @property
    def input_columns(self) -> list[str]:
        """Base columns that the selection kept or that a kept derived feature is computed from."""
        kept = set(self.selection["selected_features"])
        needed = kept | {b for f in kept & set(fe.INPUTS_OF) for b in fe.INPUTS_OF[f]}
        return [c for c in self.selection["base_features"] if c in needed]

    @property
    def vector_names(self) -> list[str]:
        """Names of the model's vector slots, from its saved assembler."""
        return self.model.stages[-2].getInputCols()


def load_bundle(spark: SparkSession, out_dir: str) -> Bundle:
    """The saved results of ``run_feature_engineering`` and ``run_evaluation``."""
    results = io.read_json_doc(spark, f"{out_dir}/evaluation_results")
    return Bundle(io.read_json_doc(spark, f"{out_dir}/selected_features"),
                  io.load_feature_state(spark, f"{out_dir}/state/role_medians"),
                  io.load_model(f"{out_dir}/models/{results['best_model']}"),
                  float(results.get("optimal_threshold", sc.DEFAULT_THRESHOLD)))


def prepare_feature_matrix(df: DataFrame, bundle: Bundle, id_col: str) -> DataFrame:
    """I4: id, engineered and selected columns from raw rows; columns that nothing needs may be absent."""
    enc.require_columns(df, bundle.input_columns)
    all_inputs = {*bundle.selection["base_features"], *(c for cols in fe.INPUTS_OF.values() for c in cols)}
    absent = sorted(all_inputs - set(bundle.input_columns))
    base = df.select(id_col, *bundle.input_columns, *[F.lit(None).cast("double").alias(c) for c in absent])
    return fe.apply_features(base, bundle.state).select(id_col, *bundle.selection["selected_features"])


def score_raw(df: DataFrame, bundle: Bundle, id_col: str, threshold: float | None = None) -> DataFrame:
    """I5–I8 for a whole table of raw rows: features, probability, saved threshold, tier, confidence."""
    matrix = prepare_feature_matrix(df, bundle, id_col)
    cut = bundle.threshold if threshold is None else threshold
    return sc.prediction_frame(sc.predict_spark_model(matrix, bundle.model, id_col, cut), id_col)


def score_record(spark: SparkSession, record: dict, schema: str, bundle: Bundle, id_col: str) -> DataFrame:
    """One record as a one-row table."""
    names = [f.split()[0] for f in schema.split(", ")]
    return score_raw(spark.createDataFrame([tuple(record.get(c) for c in names)], schema), bundle, id_col)


def encoded_linear(bundle: Bundle, matrix: DataFrame) -> tuple[sc.LinearModel, DataFrame]:
    """The fitted linear model in encoded space and ``matrix`` with the encoded columns."""
    names = bundle.vector_names
    return sc.LinearModel.from_spark(bundle.model.stages[-1], names), bundle.model.stages[0].transform(matrix)


def explain_raw(df: DataFrame, background: DataFrame, bundle: Bundle, id_col: str,
                top_n: int | None = sc.DEFAULT_TOP_N) -> DataFrame:
    """I10/I11 for every row of ``df``; the means are over all rows of ``background`` (raw rows)."""
    linear, rows = encoded_linear(bundle, prepare_feature_matrix(df, bundle, id_col))
    _, base = encoded_linear(bundle, prepare_feature_matrix(background, bundle, id_col))
    means = sc.background_means(base, list(linear.weights))
    return sc.linear_contributions(rows, linear, id_col, top_n=top_n, means=means)


def decision_log(spark, report: dict) -> DataFrame:
    """Q17: the preprocessing report as one row per step (step, detail)."""
    rows = [
        ("input", f"{report['input_columns']} columns"),
        ("deduplicate", f"{report['rows_after_dedup']} rows kept; duplicates {report['duplicates']}"),
        ("missing", f"{sum(report['missing'].values())} missing cells in {len(report['missing'])} columns"),
        ("drop", ", ".join(report["dropped_columns"]) or "none"),
        ("clean", f"{report['cleaned_columns']} columns"),
        ("outliers", f"{sum(o['outlier_count'] for o in report['outliers'])} flagged (diagnostic only)"),
        ("encode", f"{report['preprocessed_columns']} columns, {len(report['output_features'])} features"),
    ]
    return spark.createDataFrame(rows, "step string, detail string")


def logged_preprocessing(df: DataFrame, id_col: str, order_cols: Sequence[str], drop: Sequence[str],
                         nominal: Sequence[str], numeric: Sequence[str], scale: Sequence[str] = (),
                         target: str = "Attrition", positive: str = "Yes", negative: str = "No") -> tuple[DataFrame, DataFrame]:
    """T7 with its decision log (Q17) as a table: (preprocessed, log).

    The log's figures are observed metrics of the two passes that write the steps, so it costs no scan
    of its own: ``position, step, n_rows, n_columns, n_changed, detail``.  ``n_changed`` is what the step
    took or flagged: repeated rows, missing cells, dropped columns, positive labels, new features.
    """
    read, kept, made = Observation(), Observation(), Observation()
    body = [f for f in df.schema.fields if f.name not in order_cols]
    count = F.count(F.lit(1)).alias("n")
    gaps = [F.sum(pf.is_missing(f.name, f.dataType.typeName()).cast("long")).alias(f"m{i}") for i, f in enumerate(body)]
    dedup = written(cl.handle_duplicates(df.observe(read, count), id_col, order_cols).observe(kept, count, *gaps), "deduplicated")
    cleaned = cl.drop_uninformative(dedup, drop)
    labelled = cl.encode_target(cleaned, target, positive, negative)
    state = enc.fit_encoder(labelled, nominal, numeric, scale=list(scale) or None)
    pre = written(enc.transform_features(labelled, state, keep=[id_col, target, "Attrition_label"])
                  .observe(made, count, F.sum("Attrition_label").alias("positive")), "preprocessed")
    n_in, n_kept, n_made = read.get["n"], kept.get["n"], made.get["n"]
    missing = {f.name: kept.get[f"m{i}"] or 0 for i, f in enumerate(body)}
    dropped = [c for c in drop if c in dedup.columns]
    steps = [("input", n_in, len(body), 0, "rows as read"),
             ("deduplicate", n_kept, len(body), n_in - n_kept, f"first row per {id_col}"),
             ("missing", n_kept, len(body), sum(missing.values()), ", ".join(c for c in missing if missing[c])),
             ("drop", n_kept, len(cleaned.columns), len(dropped), ", ".join(dropped)),
             ("target", n_kept, len(labelled.columns), made.get["positive"] or 0, f"{positive} is 1, {negative} is 0"),
             ("encode", n_made, len(pre.columns), len(state.output_names()), ", ".join(state.output_names()))]
    log = df.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(steps, 1)],
                                          "position int, step string, n_rows long, n_columns int, n_changed long, detail string")
    return pre, log
