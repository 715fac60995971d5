"""Deterministic stratified splits, folds and samples (X1–X4) and class weights.

Membership is a function of the row key (a hash), never of partitioning or
RNG state, so every recomputation after an executor loss gives the same
split.  Exact per-class sizes need the (hash, key) of a few ranks per class:
the quota-th row for a split, the fold borders for folds.  They are found by
counting rows per class and hash prefix, again inside the border prefixes
only, until those hold few rows; the table is then split by comparing each
row with its class's borders.  No row of the table is shuffled or sorted, and the
table is read twice: once for the narrow copy (class, hash, key) that all
counting works on, once to be split.

A null label is a class of its own, so no row is lost.  Rows repeated with
one key stay on one side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, lit_d
from ..session import cut_lineage, written

HASH_RANGE = 1 << 62
LEVEL_BITS = 12          # bits of the hash that one counting pass resolves
SMALL_PREFIX = 200_000   # rows of a border prefix that are ranked directly
BROADCAST_CLASSES = 100_000


def key_hash(cols: Sequence[str], seed: int = 42) -> Column:
    """Non-negative 62-bit hash of the key columns (range [0, 2**62))."""
    return F.xxhash64(*[col(c) for c in cols], F.lit(seed)).bitwiseAND(F.lit(HASH_RANGE - 1))


def narrow_rows(df: DataFrame, label: str, h: Column, key: Sequence[str]) -> DataFrame:
    """``cls, h, k0, k1…`` of every row, written once."""
    return written(df.select(col(label).alias("cls"), h.alias("h"), *[col(c).alias(f"k{i}") for i, c in enumerate(key)]), "split-rows")


def class_counts(rows: DataFrame) -> DataFrame:
    """``cls, n``: one row per class, the null class included."""
    return cut_lineage(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")))


def split_quotas(counts: DataFrame, test_size: float = 0.2) -> DataFrame:
    """``cls, rank``: test rows per class.  The total is ceil(test_size·n); train rows are allotted
    by floor and largest remainder (ties by class, null last).  One row per class is windowed."""
    every = Window.partitionBy(F.lit(0))
    n = F.sum("n").over(every)
    n_train = n - F.ceil(lit_d(test_size) * n)
    c = counts.select("cls", "n", n_train.alias("n_train"), (F.col("n") * n_train / n).alias("share"))
    c = c.withColumn("low", F.floor("share"))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("share") - F.col("low")), F.asc_nulls_last("cls"))
    c = c.select("cls", "n", "low", (F.row_number().over(by_rest) <= F.col("n_train") - F.sum("low").over(every)).alias("more"))
    return c.select("cls", (F.col("n") - F.col("low") - F.col("more").cast("long")).alias("rank"))


def _small(classes: DataFrame) -> DataFrame:
    """A table with a few rows per class, marked for broadcast if that is few indeed."""
    return F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes


def rank_borders(rows: DataFrame, ranks: DataFrame, hash_range: int = HASH_RANGE, small: int = SMALL_PREFIX) -> DataFrame:
    """``cls, borders``: for each class the sorted (hash, key…) structs of the ``narrow_rows`` at the
    given ranks (``ranks``: cls, rank; ranks start at 1, others are ignored)."""
    keys = rows.columns[2:]
    bits = max(1, (hash_range - 1).bit_length())
    # a state: the rank-th row of a class is the left-th row with this hash prefix
    state = cut_lineage(ranks).filter("rank > 0").select("cls", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left"))
    shift = bits
    while True:
        at = F.shiftright("h", shift) if shift < 63 else F.lit(0).cast("long")
        inside = rows.withColumn("prefix", at)
        marks = _small(state.select(F.col("cls").alias("c"), F.col("prefix").alias("p")).distinct())
        inside = inside.join(marks, F.col("cls").eqNullSafe(F.col("c")) & (F.col("prefix") == F.col("p")), "left_semi")
        if shift == 0:
            break
        most = inside.groupBy("cls", "prefix").count().agg(F.max("count")).first()[0]
        if most is None or most <= small:
            break
        down = max(0, shift - LEVEL_BITS)
        counts = inside.groupBy("cls", "prefix", F.shiftright("h", down).alias("next")).agg(F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("cls", "prefix").orderBy("next")
        counts = counts.withColumn("upto", F.sum("n").over(run))  # at most 2^LEVEL_BITS rows per prefix
        state = (state.join(counts.withColumnRenamed("cls", "c").withColumnRenamed("prefix", "p"),
                            F.col("cls").eqNullSafe(F.col("c")) & (F.col("prefix") == F.col("p")))
                 .filter((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
                 .select("cls", "rank", F.col("next").alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")))
        state = cut_lineage(state)
        shift = down
    groups = inside.groupBy("cls", "prefix", "h", *keys).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("cls", "prefix").orderBy("h", *keys)
    ordered = groups.withColumn("upto", F.sum("n").over(run))
    ordered = ordered.withColumnRenamed("cls", "c").withColumnRenamed("prefix", "p")
    hit = state.join(ordered, F.col("cls").eqNullSafe(F.col("c")) & (F.col("prefix") == F.col("p"))).filter(
        (F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
    return hit.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("h", *keys))).alias("borders"))


def _past(df: DataFrame, label: str, h: Column, key: Sequence[str], borders: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` joined with its class's borders, and the number of borders before each row."""
    b = _small(cut_lineage(borders.withColumnRenamed("cls", "_cls").withColumnRenamed("borders", "_borders")))
    joined = df.join(b, col(label).eqNullSafe(F.col("_cls")), "left")
    own = F.struct(h.alias("h"), *[col(c).alias(f"k{i}") for i, c in enumerate(key)])
    return joined, F.coalesce(F.size(F.filter("_borders", lambda x: x < own)), F.lit(0))


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2,
                     seed: int = 42, h: Column | None = None, hash_range: int = HASH_RANGE,
                     split_col: str = "split", small: int = SMALL_PREFIX) -> DataFrame:
    """X1 exact mode: per-class quotas, the test rows being the quota smallest (hash, key)."""
    h = key_hash(key, seed) if h is None else h
    rows = narrow_rows(df, label, h, key)
    borders = rank_borders(rows, split_quotas(class_counts(rows), test_size), hash_range, small)
    joined, past = _past(df, label, h, key, borders)
    has = F.col("_borders").isNotNull()
    return (joined.withColumn(split_col, F.when(has & (past == 0), "test").otherwise("train"))
            .drop("_cls", "_borders"))


def hash_split(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42,
               split_col: str = "split") -> DataFrame:
    """X1 hash mode: no extra pass over the table; sizes are approximate."""
    cut = int(test_size * 10000)
    return df.withColumn(split_col, F.when(F.pmod(key_hash(key, seed), F.lit(10000)) < cut, "test")
                         .otherwise("train"))


def fold_ranks(counts: DataFrame, k: int) -> DataFrame:
    """``cls, rank``: the last rank of each fold but the last, so that class by class the folds
    have the sizes of dealing the sorted classes round-robin, one after another."""
    before = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("cls")).rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    f = c.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    # rows r = 1..n with (off + r - 1) mod k = fold
    skip = F.pmod(F.col("fold") - F.col("off"), F.lit(k))
    size = F.greatest(F.floor((F.col("n") - skip + (k - 1)) / k), F.lit(0))
    upto = Window.partitionBy("cls").orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return f.select("cls", "fold", F.sum(size).over(upto).alias("rank"))


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 7,
                     h: Column | None = None, hash_range: int = HASH_RANGE,
                     fold_col: str = "fold", small: int = SMALL_PREFIX) -> DataFrame:
    """Each class's rows in (hash, key) order, cut into ``k`` runs of the round-robin sizes."""
    h = key_hash(key, seed) if h is None else h
    rows = narrow_rows(df, label, h, key)
    ends = cut_lineage(fold_ranks(class_counts(rows), k))
    borders = rank_borders(rows, ends.filter(F.col("fold") < k - 1).select("cls", "rank"), hash_range, small)
    # folds that get no row of a small class have rank 0 or repeat a rank: count them as passed
    joined, past = _past(df, label, h, key, borders)
    shape = ends.filter(F.col("fold") < k - 1).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("fold", "rank"))).alias("_ends"))
    shape = shape.withColumnRenamed("cls", "_c")
    out = joined.join(_small(shape), col(label).eqNullSafe(F.col("_c")), "left")
    empty = F.size(F.filter("_ends", lambda e: e["rank"] == 0))
    return out.withColumn(fold_col, (past + empty).cast("int")).drop("_cls", "_borders", "_c", "_ends")


def background_sample(df: DataFrame, key: Sequence[str], n: int = 120, seed: int = 42,
                      order: Column | None = None) -> DataFrame:
    """min(n, rows) rows with the smallest key hash (TakeOrdered: no global sort)."""
    return df.orderBy(key_hash(key, seed) if order is None else order, *key).limit(n)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k · n_c) per class, and neg/max(pos, 1) for boosting."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()
    tot = F.sum("count").over(w)
    k = F.count(F.lit(1)).over(w)
    pos = F.sum(F.when(F.col(label) == 1, F.col("count")).otherwise(0)).over(w)
    neg = F.sum(F.when(F.col(label) == 0, F.col("count")).otherwise(0)).over(w)
    return c.select(label, "count", (tot / (k * F.col("count"))).alias("weight"),
                    (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"))


def with_class_weight(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight (computed on ``df`` itself, i.e. on train)."""
    w = class_weights(df, label).select(F.col(label).alias("_c"), F.col("weight").alias(weight_col))
    return df.join(_small(w), col(label).eqNullSafe(F.col("_c")), "left").drop("_c")
