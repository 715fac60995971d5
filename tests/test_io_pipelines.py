"""Sources/sinks round trips (S1–S7) and the preprocessing pipeline."""
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from hrlens.operators import encode as enc
from hrlens.plans import catalog as C
from hrlens.plans import pipelines as pl
from hrlens.sources import io


def test_parquet_csv_json_roundtrip(spark):
    o = C.O(spark, SF_SMALL).select("id", "Department", "Age", "MonthlyIncome")
    d = tempfile.mkdtemp(prefix="hrlens-io-")
    io.write_parquet(o, f"{d}/p", partition_by=["Department"])
    back = io.read_parquet(spark, f"{d}/p", ["id", "Age"])
    assert back.count() == o.count()
    io.export_csv(o, f"{d}/csv")
    schema = "id long, Department string, Age int, MonthlyIncome int"
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    assert io.read_csv(spark, f"{d}/csv", st).exceptAll(o).count() == 0
    io.write_json_doc(spark, {"optimal_threshold": 0.7844}, f"{d}/eval")
    assert io.load_threshold(spark, f"{d}/eval") == 0.7844
    assert io.load_threshold(spark, f"{d}/missing") == 0.5
    import json
    with open(f"{d}/indented.json", "w") as fh:
        json.dump({"optimal_threshold": 0.25, "models": [{"name": "a"}]}, fh, indent=2)
    assert io.load_threshold(spark, f"{d}/indented.json") == 0.25
    with open(f"{d}/broken.json", "w") as fh:
        fh.write("{")
    import pytest
    with pytest.raises(ValueError):
        io.load_threshold(spark, f"{d}/broken.json")


def _bad_csv(n_files=1):
    d = tempfile.mkdtemp(prefix="hrlens-bad-")
    for k in range(n_files):
        with open(f"{d}/part-{k}.csv", "w") as fh:
            fh.write("id,Age,OverTime\n" + "".join(
                f"{1000 * k + i},{'notanumber' if i % 40 == 7 else 30 if i % 9 else 12},Yes\n" for i in range(200)))
    return d


def test_permissive_csv_routes_bad_rows(spark):
    from pyspark.sql.types import _parse_datatype_string
    df = io.read_csv(spark, _bad_csv(), _parse_datatype_string("id long, Age int, OverTime string"), mode="PERMISSIVE")
    bad = io.corrupt_rows(df)  # straight from the reader
    assert bad.count() == 5 and bad.filter(F.col("message").startswith("Unparseable row: 7,notanumber")).count() == 1


def test_upload_with_unreadable_lines(spark):
    from pyspark.sql.types import _parse_datatype_string
    from hrlens.sources import ordered
    rows, rejected = ordered.read_upload(spark, _bad_csv(3), _parse_datatype_string("id long, Age int, OverTime string"))
    assert rows.columns == ["id", "Age", "OverTime", "row_number"]
    want = [(1000 * k + i, 200 * k + i + 1) for k in range(3) for i in range(200)]
    good = sorted((r["id"], r["row_number"]) for r in rows.collect())
    assert good == [(i, n) for i, n in want if i % 1000 % 40 != 7]
    assert sorted((r["line"].split(",")[0], r["row_number"]) for r in rejected.collect()) == sorted((str(i), n) for i, n in want if i % 1000 % 40 == 7)
    assert all(r["file"].endswith(f"part-{(r['row_number'] - 1) // 200}.csv") for r in rejected.collect())
    report = ordered.upload_report(rows, rejected, ["Age", "OverTime"], []).collect()
    fields = [r["field"] for r in report]
    assert sorted(f for f in fields if "." not in f) == sorted(f"row_{n}" for i, n in want if i % 1000 % 40 == 7)
    assert sorted(f for f in fields if "." in f) == sorted(f"row_{n}.Age" for i, n in want if i % 1000 % 9 == 0 and i % 1000 % 40 != 7)


def test_row_numbers_of_many_files_and_parts(spark):
    from hrlens.sources import ordered
    d = tempfile.mkdtemp(prefix="hrlens-order-")
    spark.range(0, 5000, 1, 7).write.parquet(f"{d}/p")
    spark.range(0, 5000, 1, 7).write.csv(f"{d}/c")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")   # several parts a file
    try:
        for df in (spark.read.parquet(f"{d}/p"), spark.read.schema("id long").csv(f"{d}/c")):
            got = ordered.with_row_numbers(df).collect()
            assert sorted((r["row_number"], r["id"]) for r in got) == [(i + 1, i) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ordered.with_row_numbers(spark.read.parquet(f"{d}/p").limit(0)).count() == 0


def test_state_roundtrip(spark):
    o = C.O(spark, SF_SMALL)
    st = enc.fit_one_hot(o, ["Department", "JobRole"])
    d = tempfile.mkdtemp(prefix="hrlens-state-")
    io.save_one_hot(st, spark, f"{d}/cats")
    assert io.load_one_hot(spark, f"{d}/cats").categories == st.categories


def test_preprocessing_pipeline(spark):
    from hrlens.sources.proxies import duplicates_view
    dup = duplicates_view(C.O(spark, SF_SMALL)).filter(F.col("WorkLifeBalance").isNotNull()) \
        .filter(F.col("qty").isNotNull())
    out = tempfile.mkdtemp(prefix="hrlens-pre-")
    pre, report = pl.run_preprocessing(dup, "id", ["src"], ["StandardHours"], ["Department", "OverTime"],
                                       ["Age", "MonthlyIncome"], scale=["MonthlyIncome"], out_dir=out)
    assert set(io.load_scaler(spark, f"{out}/state/scaler").moments) == {"MonthlyIncome"}
    assert io.load_one_hot(spark, f"{out}/state/categories").categories.keys() == {"Department", "OverTime"}
    n_ids = dup.select("id").distinct().count()
    assert pre.count() == n_ids == report["rows_after_dedup"]
    assert report["duplicates"]["duplicate_ids"] > 0
    assert "StandardHours" in report["dropped_columns"]
    assert pre.columns[:3] == ["id", "Attrition", "Attrition_label"]
    log = pl.decision_log(spark, report)
    assert log.count() == 7


def test_feature_catalog(spark):
    from hrlens.operators import features as fe
    assert [r.feature for r in fe.engineered_feature_catalog(spark).collect()] == fe.ENGINEERED
