"""Stored sketches against exact profiles, the feature registry and the catalog of derived columns."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hrlens.operators import features as fe
from hrlens.operators import profile as pf
from hrlens.operators import sketches as sk
from hrlens.sources.proxies import employee_view


@pytest.fixture
def wide(spark):
    """90,000 rows in three parts and one without a name; up to 60,000 distinct values a column."""
    i = F.col("id")
    return spark.range(90_000).select(
        F.when(i % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit("p"), i % 4)).alias("day"),
        (i % 60_000).alias("many"), (i % 60_000).cast("string").alias("text"), (i % 7 / 2).alias("few"),
        F.when(i % 5 > 0, (i % 20_011).cast("int")).alias("gaps"), F.lit(None).cast("int").alias("none"), F.lit(1).alias("a b"))


def rows(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_merged_parts_are_near_the_exact_counts(spark, wide, tmp_path):
    path = str(tmp_path / "s")
    sk.update(wide, "day", path)
    exact, near = rows(pf.schema_overview(wide)), rows(sk.schema_overview(spark, path))
    assert exact.keys() == near.keys()
    for c, e in exact.items():
        n = near[c]
        assert (n["position"], n["dtype"], n["non_null_count"]) == (e["position"], e["dtype"], e["non_null_count"])
        assert abs(n["unique_values"] - e["unique_values"]) <= 0.03 * e["unique_values"]
        if e["unique_values"] < 100:
            assert n["unique_values"] == e["unique_values"]


def test_new_parts_merge_without_reading_old_ones(spark, wide, tmp_path):
    path, src = str(tmp_path / "s"), str(tmp_path / "t")
    wide.filter("day = 'p0'").write.partitionBy("day").parquet(src)
    sk.update(spark.read.parquet(src), "day", path)
    assert {r["part"] for r in sk.stored(spark, path).select("part").distinct().collect()} == {"p0"}
    wide.filter("day is null or day <> 'p0'").write.mode("append").partitionBy("day").parquet(src)
    new = sk._new_parts(spark.read.parquet(src), "day", sk.stored(spark, path))
    files = new.select("many").inputFiles()
    plan = new.select("many")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "p1" in plan and files
    assert rows(new.groupBy("day").count(), "day").keys() == {None, "p1", "p2"}
    sk.update(spark.read.parquet(src), "day", path)
    sk.update(spark.read.parquet(src), "day", path)  # nothing is new
    whole = str(tmp_path / "w")
    sk.update(wide, "day", whole)
    both = [rows(sk.schema_overview(spark, p).drop("position")) for p in (path, whole)]
    assert both[0] == both[1]
    one = rows(sk.schema_overview(spark, path, parts=["p1", None]))
    assert one["many"]["non_null_count"] == wide.filter("day = 'p1' or day is null").count()


def test_a_part_can_be_sketched_again(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "part string, x int")
    sk.update(first, "part", path)
    sk.update(spark.createDataFrame([("a", 9)], "part string, x int"), "part", path)  # held already
    assert rows(sk.schema_overview(spark, path))["x"]["unique_values"] == 3
    sk.update(spark.createDataFrame([("a", 9)], "part string, x int"), "part", path, again=True)
    got = rows(sk.schema_overview(spark, path))["x"]
    assert (got["non_null_count"], got["unique_values"]) == (2, 2)


def test_many_new_parts_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sk, "LISTED_PARTS", 2)
    df = spark.range(100).select((F.col("id") % 10).alias("part"), "id")
    path = str(tmp_path / "s")
    sk.update(df.filter("part = 3"), "part", path)
    sk.update(df, "part", path)
    assert sk.stored(spark, path).select("part").distinct().count() == 10
    assert rows(sk.schema_overview(spark, path))["id"]["unique_values"] == 100


def test_empty_table_and_unnamed_parts(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("", 1), (None, 2), (None, None)], "part string, x int")
    sk.update(df.limit(0), "part", path)
    assert sk.schema_overview(spark, path).count() == 0
    sk.update(df, "part", path)
    sk.update(df, "part", path)
    got = rows(sk.schema_overview(spark, path))["x"]
    assert (got["non_null_count"], got["unique_values"]) == (2, 2)


def test_groups_and_ranking(spark, wide, tmp_path):
    path = str(tmp_path / "s")
    sk.update(wide, "day", path)
    ranking = sk.cardinality_ranking(spark, path, ["few", "day", "none"]).collect()
    assert [tuple(r) for r in ranking] == [("few", 7), ("day", 3), ("none", 0)]
    got = rows(sk.column_groups(spark, path, {"g": ["few", "absent"]}))
    assert got["few"]["unique_values"] == 7 and got["absent"]["dtype"] is None


def test_registry_states(spark):
    spec = pf.FeatureSpec
    df = spark.createDataFrame([(1, "x", 5.0, 7, None, "q"), (2, "z", float("nan"), 7, None, "r"), (None, None, 99.0, 7, None, "r")],
                               "a int, b string, c double, d int, e int, f string")
    got = rows(pf.feature_registry(df, [
        spec("a", "continuous", "", "keep", "", 0, 2), spec("b", "nominal", "", "keep", "", values="x|y"),
        spec("c", "continuous", "", "keep", "", None, 10), spec("d", "continuous", "", "keep", ""), spec("e", "constant", "", "drop", ""),
        spec("g", "ordinal", "", "keep", "")]))
    assert {c: (r["status"], r["missing"], r["outside"]) for c, r in got.items()} == {
        "a": ("ok", 1, 0), "b": ("outside", 1, 1), "c": ("outside", 1, 1), "d": ("constant", 0, 0), "e": ("ok", 3, 0),
        "f": ("unregistered", 0, 0), "g": ("missing", None, None)}
    assert (got["c"]["min"], got["c"]["max"], got["b"]["min"]) == (5.0, 99.0, None)
    empty = rows(pf.feature_registry(df.limit(0), [spec("a", "continuous", "", "keep", "")]))
    assert (empty["a"]["status"], empty["a"]["missing"], empty["a"]["min"]) == ("ok", 0, None)


def test_derived_columns_report(spark):
    o = employee_view(spark, SF_SMALL)
    out = fe.apply_features(o, None, features=["burnout_risk_flag", "job_stability_index"])
    got = rows(fe.engineered_feature_report(out), "feature")
    assert set(got) == set(fe.ENGINEERED)
    assert got["burnout_risk_flag"]["values"] == o.count() and got["role_tenure_share"]["values"] is None
    want = out.agg(F.min("job_stability_index"), F.max("job_stability_index")).first()
    assert (got["job_stability_index"]["min"], got["job_stability_index"]["max"]) == tuple(want)
    assert fe.engineered_feature_report(o).count() == len(fe.ENGINEERED)
