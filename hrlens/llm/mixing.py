"""Operator 5: mixing sources to target weights.

Sizes are summed per source, targets are found by reshaping the excess of capped sources, and each
document is emitted ``floor(rate)`` times plus once more when its hash-seeded coin falls below the
rate's fraction.  Coins are a function of the document's id and the seed, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
source of size 0 has target 0 and none of its documents is taken; rows repeated with one id share
their coin; null ids share one coin per text; an empty table gives no rows; only the id, text and
source columns are read (``emit`` keeps all others).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.store import free_name, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.coalesce(F.md5(text), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Ranks come from a range-partitioned sort and per-partition offsets; each reshaping round is one
    aggregate of two numbers.
    """
    ordered = staged(sizes.repartitionByRange(F.col("source").asc_nulls_last())
                     .sortWithinPartitions(F.col("source").asc_nulls_last())
                     .withColumn("mid", F.monotonically_increasing_id()), "mix-sources")
    part, place = F.shiftright("mid", 33), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in ordered.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row per partition
        offsets += [F.lit(r["p"]), F.lit(before)]
        before += r["count"]
    if not offsets:
        return sizes.withColumn("target", F.lit(0.0))
    rank = F.element_at(F.create_map(*offsets), part) + place
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighted = ordered.select("source", "source_size", weight.alias("w"))
    cap = most * F.col("source_size")
    total, weight_sum = weighted.agg(F.sum("source_size"), F.sum("w")).first()
    level, capped = share * total / weight_sum, -1
    while True:
        over = F.col("w") * F.lit(level) >= cap
        n, caps, free = weighted.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
                                     F.sum(F.when(~over, F.col("w")))).first()
        if n == capped or free is None:
            break
        capped, level = n, (share * total - caps) / free
    return weighted.select("source", "source_size", F.least(F.col("w") * F.lit(float(level)), cap.cast("double")).alias("target"))


def mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **shape) -> DataFrame:
    """``docs`` with a struct column ``mix``: ``size, source_size, target, copies, taken``."""
    name, g = free_name(docs, "mix"), free_name(docs, "goal")
    size = word_count(F.col(text_col).cast("string"))
    sums = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(size).alias("source_size"))
    goal = staged(targets(sums, **shape), "mix-targets").select(F.struct("source", "source_size", "target").alias(g))
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)  # at most BROADCAST_SOURCES rows
    joined = docs.join(goal, F.col(source_col).cast("string").eqNullSafe(F.col(g)["source"]))
    known, target = F.col(g)["source_size"], F.col(g)["target"]
    rate = F.when(known > 0, target / known).otherwise(0.0)
    extra = coin(F.col(id_col), F.col(text_col), seed) < rate - F.floor(rate)
    copies = (F.floor(rate) + extra.cast("long")).cast("int")
    return joined.withColumn(name, F.struct(size.alias("size"), known.alias("source_size"), target.alias("target"),
                                            copies.alias("copies"), (size * copies).alias("taken"))).drop(g)


def emit(docs: DataFrame, **shape) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``."""
    rows = mix(docs, **shape)
    name = rows.columns[-1]
    return (rows.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(name)["copies"]))).drop(name))
