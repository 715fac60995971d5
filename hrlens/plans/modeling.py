"""Model training, tuning, importance and evaluation on Spark ML.

* L1: the fitted encoder (null policy, one-hot, scaling as one projection) becomes a
  ``SQLTransformer`` stage, followed by ``VectorAssembler`` and the classifier, so one
  ``PipelineModel`` holds the whole scoring path and saves/loads as a unit (S7).
* Null policy of all models: a missing number is replaced by the train mean, and every column that
  had one in train gets a 0/1 indicator; a missing category is the all-zero code.  No row is left out.
* L2–L5: logistic regression (Spark ML), decision tree, random forest and boosted trees
  (``plans.trees``), each with class weights (L6).
* L7: grid search over a deterministic stratified ``fold`` column (X2), area under ROC.  Encoder,
  null policy and class weights are fitted on each fold's training rows only; one written table holds
  every row under all folds' encoders.  All candidates and folds of a model are searched together:
  logistic regression in the same Newton passes, trees in the same level passes, and a grown ensemble
  stands for all candidates that are cuts of it.  The best one is refitted on all training rows.  The models
  are searched side by side, as their passes are many short jobs; encoders, tables and bins are worked out once.
* Evaluation (M15): every row is scored once by every model into one table
  (model, id, split, y, p), and all metrics are aggregates of that table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import encode as enc
from ..operators import metrics as mt
from ..operators.split import stratified_folds, with_class_weight
from ..session import cut_lineage, library_on_workers
from . import logistic, trees


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(c: str, state: enc.EncoderState) -> str:
    x = f"nanvl(CAST({_q(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    return f"coalesce({x}, {state.fill[c]!r}D)" if c in state.fill else f"coalesce({x}, 0D)"


def encoder_parts(state: enc.EncoderState) -> list[tuple[str, str]]:
    """(SQL expression, column name) of every encoded column.

    A column without missing entries in train that has one when scored gets 0 (the mean, if scaled).
    """
    parts = []
    for c, vals in state.nominal.categories.items():
        for v in vals[1:]:
            parts.append((f"CAST(coalesce({_q(c)} = {_lit(v)}, false) AS DOUBLE)", f"{c}_{v}__h"))
    if state.scaler:
        for c, (m, s) in state.scaler.moments.items():
            scale = 1.0 if not s else s
            x = f"nanvl(CAST({_q(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
            parts.append((f"coalesce(({x} - ({(m or 0.0)!r}D)) / ({scale!r}D), 0D)", c + "__s"))
    for c in state.passthrough:
        parts.append((_number(c, state), c + "__p"))
    for c in state.fill:
        parts.append((f"CAST({_q(c)} IS NULL OR isnan(CAST({_q(c)} AS DOUBLE)) AS DOUBLE)", c + "__m"))
    return parts


def encoder_sql(state: enc.EncoderState) -> str:
    """The fitted projection as a SQL statement over ``__THIS__``."""
    return "SELECT *, " + ", ".join(f"{e} AS {_q(c)}" for e, c in encoder_parts(state)) + " FROM __THIS__"


def encoded_columns(state: enc.EncoderState) -> list[str]:
    return [c for _, c in encoder_parts(state)]


def feature_names(state: enc.EncoderState) -> list[str]:
    """Display names of the assembled vector slots."""
    return state.output_names()


def encoder_stages(state: enc.EncoderState) -> list:
    return [SQLTransformer(statement=encoder_sql(state)),
            VectorAssembler(inputCols=encoded_columns(state), outputCol="features")]


@dataclass
class ModelSpec:
    """A model and its grid; a candidate is a dict of the reference's parameter names."""
    name: str
    grid: list[dict] = field(default_factory=list)
    scale: bool = False


UNLIMITED = 30   # depth "none"


def _grid(**axes) -> list[dict]:
    return [dict(zip(axes, values)) for values in product(*axes.values())]


def model_specs(full_grid: bool = True) -> list[ModelSpec]:
    """L2–L5 with the reference's grids (4, 45, 54 and 108 candidates): the solver of the logistic
    regression collapses (one optimum), and depth "none" is 30.

    ``full_grid=False`` is the grid of the registered queries: all candidates of logistic regression
    and tree, and small forests and boosted ensembles (see README for the seconds a candidate).
    """
    pick = (lambda full, short: full) if full_grid else (lambda full, short: short)
    return [ModelSpec("logistic_regression", _grid(C=[0.01, 0.1, 1.0, 10.0]), scale=True),
            ModelSpec("decision_tree", _grid(max_depth=[3, 5, 8, 12, UNLIMITED], min_samples_split=[2, 10, 20], min_samples_leaf=[1, 5, 10])),
            ModelSpec("random_forest", _grid(n_estimators=pick([100, 200, 300], [10, 20]), max_depth=pick([5, 10, UNLIMITED], [3, 5]),
                                             min_samples_split=[2, 5, 10], max_features=["sqrt", "log2"])),
            ModelSpec("gradient_boosting", _grid(n_estimators=pick([100, 200, 300], [5, 10]), max_depth=pick([3, 5, 7], [3]),
                                                 learning_rate=pick([0.01, 0.05, 0.1], [0.1, 0.3]), subsample=[0.8, 1.0],
                                                 colsample_bytree=[0.8, 1.0]))]


@dataclass
class TrainedModel:
    name: str
    model: PipelineModel
    encoder: enc.EncoderState
    cv_auc: float
    best_params: dict
    n_rows: int = 0
    searched: list[tuple[dict, float]] = field(default_factory=list)


def prepare(train: DataFrame, label: str, key: Sequence[str], folds: int, seed: int = 7) -> DataFrame:
    """The training rows with deterministic stratified folds, checkpointed once.

    Every fold and grid point re-reads this table; a reliable checkpoint (in ``spark.checkpoint.dir``)
    survives executor loss and keeps the optimizer's constraint inference from exploding over the
    wide encoded projection.
    """
    return cut_lineage(stratified_folds(train, label, list(key), k=folds, seed=seed))


def _spread(df: DataFrame) -> DataFrame:
    """At least as many parts as cores: training reads a table many times, and a small written table
    comes back as one part."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _encoded(scale: bool, rows: DataFrame, nominal: Sequence[str], numeric: Sequence[str],
             label: str, state: enc.EncoderState | None = None) -> tuple[enc.EncoderState, list, DataFrame, int]:
    """Encoder fitted on ``rows`` and the rows encoded, weighted and checkpointed."""
    state = state or enc.fit_encoder(rows, nominal, numeric, scale=list(numeric) if scale else None, impute=True)
    stages = encoder_stages(state)
    data = cut_lineage(_spread(PipelineModel(stages=stages).transform(with_class_weight(rows, label, "weight"))
                               .select(label, "weight", "features")))
    return state, stages, data, data.count()


def fold_table(train: DataFrame, states: dict[int, enc.EncoderState], label: str) -> DataFrame:
    """``h`` (hash of the row), ``y, fold`` and the row under each state's encoder as ``x{fold}``,
    written once; rows without label are left out."""
    arrays = [f"array({', '.join(e for e, _ in encoder_parts(s))}) AS x{f}" for f, s in states.items()]
    return cut_lineage(_spread(train.filter(F.col(label).isNotNull()).select(
        F.xxhash64(*[F.col(_q(c)) for c in sorted(train.columns)]).alias("h"), F.col(label).cast("int").alias("y"),
        F.col("fold").cast("int").alias("fold"), *[F.expr(a) for a in arrays])))


def fold_weights(rows: DataFrame, folds: Sequence[int]) -> dict[int, tuple[tuple[float, float], float]]:
    """Per fold, over the rows outside of it: balanced weights of the classes 0 and 1, and negatives
    over positives (L6)."""
    n: dict[tuple[int, int], int] = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    out = {}
    for f in folds:
        neg, pos = (sum(c for (g, y), c in n.items() if g != f and y == k) for k in (0, 1))
        out[f] = ((neg + pos) / (2 * max(neg, 1)), (neg + pos) / (2 * max(pos, 1))), neg / max(pos, 1)
    return out


def tree_plan(name: str, grid: Sequence[dict], folds: Sequence[int], weights: dict, sizes: dict[int, int],
              seed: int = 42) -> tuple[list[trees.Ensemble], list[trees.Cut]]:
    """The ensembles that contain all candidates of a grid, per fold, and the candidates as cuts of them
    (named by their place in the grid)."""
    ensembles: list[trees.Ensemble] = []
    cuts: list[trees.Cut] = []
    for f in folds:
        balanced, positive = weights[f]
        where: dict[tuple, int] = {}
        for i, c in enumerate(grid):
            if name == "gradient_boosting":
                key = (c["max_depth"], c["learning_rate"], c["subsample"], c["colsample_bytree"])
                same = [d for d in grid if (d["max_depth"], d["learning_rate"], d["subsample"], d["colsample_bytree"]) == key]
                e = trees.Ensemble("logistic", f, (1.0, positive), max(d["n_estimators"] for d in same), c["max_depth"], rate=c["learning_rate"],
                                   rows=None if c["subsample"] >= 1 else c["subsample"],
                                   columns=None if c["colsample_bytree"] >= 1 else c["colsample_bytree"], seed=seed)
                cut = (c["n_estimators"], None, 0)
            elif name == "random_forest":
                key = (c["max_features"],)
                some = math.sqrt(sizes[f]) if c["max_features"] == "sqrt" else math.log2(max(2, sizes[f]))
                e = trees.Ensemble("gini", f, balanced, max(d["n_estimators"] for d in grid), max(d["max_depth"] for d in grid),
                                   min(d["min_samples_split"] for d in grid), rows="poisson", columns=max(1, int(some)), seed=seed)
                cut = (c["n_estimators"], c["max_depth"], c["min_samples_split"])
            else:
                key = (c["min_samples_leaf"],)
                e = trees.Ensemble("gini", f, balanced, 1, max(d["max_depth"] for d in grid), min(d["min_samples_split"] for d in grid),
                                   c["min_samples_leaf"], seed=seed)
                cut = (1, c["max_depth"], c["min_samples_split"])
            if key not in where:
                where[key] = len(ensembles)
                ensembles.append(e)
            cuts.append(trees.Cut(str(i), where[key], *cut))
    return ensembles, cuts


def _once(shared: dict, key, make: Callable):
    """``shared[key]``, made by the first that asks for it."""
    with shared.setdefault(("lock", key), Lock()):
        if key not in shared:
            shared[key] = make()
        return shared[key]


def _encoders(shared: dict, train: DataFrame, nominal: Sequence[str], numeric: Sequence[str], folds: int) -> dict:
    """Encoder states of all folds and of all rows (None): (plain, scaled)."""
    return _once(shared, "encoders", lambda: enc.fit_encoders(train, nominal, numeric, [*range(folds), None], scale=list(numeric)))


def search(spec: ModelSpec, train: DataFrame, nominal: Sequence[str], numeric: Sequence[str], label: str = "label",
           folds: int = 5, seed: int = 42, shared: dict | None = None) -> list[float]:
    """Mean area under ROC over the folds of every candidate of ``spec.grid``, in its order.
    ``shared`` keeps the encoded and binned tables between searches over the same ``train``."""
    library_on_workers(train.sparkSession)
    shared = {} if shared is None else shared
    states = {f: both[spec.scale] for f, both in _encoders(shared, train, nominal, numeric, folds).items() if f is not None}
    table = _once(shared, ("table", spec.scale), lambda: fold_table(train, states, label))
    weights = _once(shared, "weights", lambda: fold_weights(table, range(folds)))
    if spec.name == "logistic_regression":
        fits = logistic.fit_many(table, [(c["C"], f) for c in spec.grid for f in range(folds)], {f: w for f, (w, _) in weights.items()})
        scores = logistic.held_out_scores(table, fits)
        names = [repr(c["C"]) for c in spec.grid]
    else:
        sizes = {f"x{f}": len(encoder_parts(s)) for f, s in states.items()}
        bins = _once(shared, "bins", lambda: trees.binned(table, list(sizes), edges=trees.ranked_borders(table, sizes)))
        packed = _once(shared, "packed", lambda: trees.packed(bins, range(folds)))
        ensembles, cuts = tree_plan(spec.name, spec.grid, range(folds), weights, {f: len(s.output_names()) for f, s in states.items()}, seed)
        later: dict[int, list[int]] = {}
        grown = trees.grow(bins, ensembles, later, packed)
        scores = trees.held_out_scores(bins, ensembles, grown, cuts, later, packed)
        names = [str(i) for i in range(len(spec.grid))]
    auc: dict[str, float] = {}
    for r in mt.roc_auc(scores, ["model", "fold"]).collect():   # candidates x folds
        auc[r["model"]] = auc.get(r["model"], 0.0) + (r["roc_auc"] or 0.0) / folds
    return [auc.get(n, 0.0) for n in names]


def fit_candidate(spec: ModelSpec, candidate: dict, train: DataFrame, nominal: Sequence[str], numeric: Sequence[str],
                  label: str = "label", seed: int = 42, shared: dict | None = None) -> tuple[PipelineModel, enc.EncoderState, int]:
    """L1: one candidate fitted on all rows of ``train``, as a pipeline with its encoder.  ``shared`` as in ``search``."""
    shared = {} if shared is None else shared
    state = (_once(shared, "encoders", lambda: enc.fit_encoders(train, nominal, numeric, [None], scale=list(numeric))))[None][spec.scale]
    if spec.name == "logistic_regression":
        state, stages, data, n = _encoded(True, train, nominal, numeric, label, state)
        lr = LogisticRegression(labelCol=label, weightCol="weight", featuresCol="features", elasticNetParam=0.0,
                                standardization=False, maxIter=2000, regParam=1.0 / (candidate["C"] * max(n, 1)))
        return PipelineModel(stages=[*stages, lr.fit(data)]), state, n
    library_on_workers(train.sparkSession)
    whole = 1 << 20                                       # a fold that no row is in

    def binned() -> tuple:
        table = fold_table(train.withColumn("fold", F.lit(0)), {whole: state}, label)
        bins = trees.binned(table, [f"x{whole}"], edges=trees.ranked_borders(table, {f"x{whole}": len(encoder_parts(state))}))
        return bins, trees.packed(bins, [whole]), fold_weights(table, [whole]), table.count()

    bins, packed, weights, n = _once(shared, "whole", binned)
    ensembles, cuts = tree_plan(spec.name, [candidate], [whole], weights, {whole: len(state.output_names())}, seed)
    grown = trees.grow(bins, ensembles, packed=packed)[0]
    model = trees.TreeModel.of(ensembles[0], grown, bins.edges[f"x{whole}"])
    return PipelineModel(stages=[*encoder_stages(state), model]), state, n


def train_single_model(spec: ModelSpec, train: DataFrame, nominal: Sequence[str],
                       numeric: Sequence[str], label: str = "label", folds: int = 5, seed: int = 42,
                       shared: dict | None = None) -> TrainedModel:
    """L1 + L7: grid search with stratified CV (mean ROC-AUC over ``fold`` 0..folds-1), then the best
    candidate (ties: the first) fitted on all rows of ``train``."""
    shared, grid = {} if shared is None else shared, spec.grid or [{}]
    mean = search(spec, train, nominal, numeric, label, folds, seed, shared)
    best = max(range(len(grid)), key=lambda i: (mean[i], -i))
    model, state, n = fit_candidate(spec, grid[best], train, nominal, numeric, label, seed, shared)
    return TrainedModel(spec.name, model, state, float(mean[best]), grid[best], n, list(zip(grid, mean)))


def score_table(model: TrainedModel, df: DataFrame, id_col: str, label: str = "label",
                keep: Sequence[str] = ()) -> DataFrame:
    """(model, id, y, p) and ``keep`` for any fitted pipeline."""
    out = model.model.transform(df)
    return out.select(F.lit(model.name).alias("model"), F.col(id_col).alias("id"),
                      F.col(label).cast("int").alias("y"),
                      vector_to_array("probability")[1].alias("p"), *keep)


def score_all(models: Sequence[TrainedModel], df: DataFrame, id_col: str, label: str = "label",
              keep: Sequence[str] = ("split",)) -> DataFrame:
    """Every row scored once by every model, written to the shared folder."""
    parts = [score_table(m, df, id_col, label, keep) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out)


def comparison_table(scores: DataFrame, models: Sequence[TrainedModel] | None = None) -> DataFrame:
    """M13 + M12 (+ CV results) from a score table with ``split`` train / test, unrounded."""
    m = mt.scalar_metrics(scores, ["model", "split"])
    test = m.filter("split = 'test'").drop("split")
    train = m.filter("split = 'train'").select("model", F.col("roc_auc").alias("train_roc_auc"), F.col("f1").alias("train_f1"))
    gap = F.col("train_roc_auc") - F.col("roc_auc")
    out = test.join(train, "model", "left").withColumn("roc_auc_gap", gap).withColumn("overfit_class", mt.overfit_class(gap))
    if models is not None:
        rows = [(t.name, t.cv_auc, str(sorted(t.best_params.items()))) for t in models]
        out = out.join(scores.sparkSession.createDataFrame(rows, "model string, cv_roc_auc double, best_params string"), "model")
    return out


def run_training(table: DataFrame, nominal: Sequence[str], numeric: Sequence[str], id_col: str,
                 label: str = "label", folds: int = 5, full_grid: bool = True,
                 models: Sequence[str] | None = None, seed: int = 42) -> tuple[list[TrainedModel], DataFrame]:
    """Train every model on the rows with ``split`` = 'train' and score all rows once.

    Returns the models and the score table (model, id, y, p, split).
    """
    prepared = prepare(table.filter(F.col("split") == "train"), label, [id_col], folds)
    shared: dict = {}
    specs = [spec for spec in model_specs(full_grid) if not models or spec.name in models]
    one = inheritable_thread_target(table.sparkSession)(
        lambda spec: train_single_model(spec, prepared, nominal, numeric, label, folds, seed, shared))
    with ThreadPoolExecutor(max(1, len(specs))) as pool:
        trained = list(pool.map(one, specs))
    return trained, score_all(trained, table, id_col, label)


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """|coefficient| (linear) or impurity importance (trees) per vector slot."""
    values = model.coefficients.toArray() if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return [(n, abs(float(v))) for n, v in zip(names, values)]


def feature_importance(model: TrainedModel, top_n: int | None = 15) -> DataFrame:
    """Importance per encoded feature, ranked, top-n."""
    from pyspark.sql import SparkSession
    rows = importances(model.model.stages[-1], feature_names(model.encoder))
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    df = df.limit(top_n) if top_n else df
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def rf_importance(train: DataFrame, nominal: Sequence[str], numeric: Sequence[str],
                  label: str = "label", num_trees: int = 300, max_depth: int = 30,
                  seed: int = 42) -> DataFrame:
    """Random-forest impurity importance of every encoded feature over all rows, desc, 6 dp.

    Importance is keyed by encoded names (a nominal column appears as its one-hot slots), as in the
    reference; a column with missing entries also has its indicator.  The forest has 32 bins a feature,
    ceil(sqrt) of the columns a node, Poisson draws by hash of the row (the same whatever the partitions),
    and every tree counts the same.
    """
    library_on_workers(train.sparkSession)
    state = enc.fit_encoder(train, nominal, numeric, impute=True)
    names, whole = state.output_names(), 1 << 20                   # a fold that no row is in
    table = fold_table(train.withColumn("fold", F.lit(0)), {whole: state}, label)
    bins = trees.binned(table, [f"x{whole}"], bins=32)
    forest = trees.Ensemble("gini", whole, fold_weights(table, [whole])[whole][0], num_trees, max_depth, rows="poisson",
                            columns=math.ceil(math.sqrt(len(names))), seed=seed)
    rows = [(n, round(v, 6)) for n, v in zip(names, trees.mean_importance(trees.grow(bins, [forest])[0], len(names)))]
    return (train.sparkSession.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))
