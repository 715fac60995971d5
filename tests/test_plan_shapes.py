"""Scale properties visible in the physical plans (the README's claims, checked)."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hrlens.operators import clean as cl
from hrlens.operators import metrics as mt
from hrlens.operators import score as sc
from hrlens.operators import split as sp
from hrlens.plans import catalog as C


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_is_an_aggregate_not_a_window(spark):
    from hrlens.sources.proxies import duplicates_view
    p = plan(cl.handle_duplicates(duplicates_view(C.O(spark, SF_SMALL)), "id", ["src"]))
    assert "Window" not in p
    assert any(a in p for a in ("HashAggregate", "ObjectHashAggregate", "SortAggregate"))


def test_auc_has_no_single_partition_exchange(spark):
    p = plan(mt.roc_auc(C.C(spark, SF_SMALL)))
    assert "SinglePartition" not in p
    assert "Window" in p


def test_stratified_split_neither_sorts_nor_shuffles_the_table(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    s = sp.stratified_split(df, "label", ["id"], small=100)
    p = plan(s)
    assert "Sort" not in p and "hashpartitioning" not in p and "Window" not in p
    assert s.filter("split = 'test'").count() == 200


def test_curve_buckets_follow_the_scores(spark):
    """Scores of a rare event all lie near 0; they must still spread over many windows."""
    df = spark.range(5000).select(F.lit("m").alias("model"), (F.col("id") % 11 == 0).cast("int").alias("y"),
                                  (F.col("id") / 1e10).alias("p"))
    from hrlens.operators.quantile import bucketed
    assert bucketed(df, "p", "b").select("b").distinct().count() > 500
    import numpy as np
    y, p = zip(*[(r["y"], r["p"]) for r in df.collect()])
    y, p = np.array(y), np.array(p)
    gt = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    assert abs(mt.roc_auc(df).first()["roc_auc"] - gt) < 1e-12


def test_quantiles_move_no_raw_rows_by_class(spark):
    from hrlens.operators import segments as seg
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (seg.box_stats(C.O(spark, SF_SMALL), "Age"), seg.histogram_density(C.O(spark, SF_SMALL), "MonthlyIncome")):
            assert "parquet" not in plan(df).lower()  # only the checkpointed value counts are read
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scoring_with_given_means_adds_no_shuffle(spark):
    o = C.O(spark, SF_SMALL).select("id", "Age", "MonthlyIncome")
    model = sc.LinearModel(0.1, {"Age": 0.01, "MonthlyIncome": -0.0001})
    p = plan(sc.linear_contributions(o, model, "id", means={"Age": 40.0, "MonthlyIncome": 5000.0}))
    base = plan(o)
    assert p.count("Exchange") == base.count("Exchange")


def test_threshold_search_reduces_before_window(spark):
    p = plan(mt.optimal_threshold(C.C(spark, SF_SMALL)))
    assert "SinglePartition" not in p


def test_split_and_folds_read_the_table_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = (spark.range(3000).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
          .mapInArrow(count, "id long, label int"))
    sp.stratified_split(df, "label", ["id"], small=100).write.format("noop").mode("overwrite").save()
    assert read.value == 6000
    sp.stratified_folds(df, "label", ["id"], k=5, small=100).write.format("noop").mode("overwrite").save()
    assert read.value == 12000
