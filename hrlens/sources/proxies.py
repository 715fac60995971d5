"""Employee-like and score-like views over the driver's TPC-H-style tables.

``employee_view`` (view O) gives one wide, employee-shaped row per order;
``score_view`` (view C) gives a two-model score table over the same ids.
Both are pure DataFrame plans over the whole input tables, so their work
grows with the data.  The SQL twins (``O_SQL`` / ``C_SQL``) are the oracle
form used by DuckDB and are identical in meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import lit_d


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _int(c: Column) -> Column:
    return c.cast("int")


def employee_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View O: one employee-like row per order (orders ⋈ customer ⋈ nation ⋈ region ⟕ line stats).

    The line statistics are aggregated per order *before* the join (partial
    aggregation map-side, one shuffle on the order key), so lineitem never
    crosses the join at full width.  nation/region are fixed-size dimensions;
    the planner broadcasts them from its own size estimate.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_quantity", "l_discount")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n_lines"),
             F.sum("l_quantity").alias("qty"),
             F.max("l_discount").alias("max_discount"))
    )
    geo = (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select("c_custkey", "c_mktsegment", "r_name"))
    j = (o.join(geo, o.o_custkey == geo.c_custkey)
          .join(lines, o.o_orderkey == lines.l_orderkey, "left"))
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    yac = ck % 15
    return j.select(
        k.alias("id"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("Attrition"),
        F.col("c_mktsegment").alias("Department"),
        F.col("o_orderpriority").alias("JobRole"),
        F.col("r_name").alias("Region"),
        F.when(k % 3 == 0, "Yes").otherwise("No").alias("OverTime"),
        _int(F.lit(18) + (k * 31) % 43).alias("Age"),
        _int(F.floor(F.col("o_totalprice") / 25)).alias("MonthlyIncome"),
        _int(yac).alias("YearsAtCompany"),
        _int(yac + k % 12).alias("TotalWorkingYears"),
        _int(F.floor(yac * lit_d(0.6))).alias("YearsInCurrentRole"),
        _int(F.floor(yac * lit_d(0.5))).alias("YearsWithCurrManager"),
        _int(k % 7).alias("YearsSinceLastPromotion"),
        _int(k % 10).alias("NumCompaniesWorked"),
        _int(1 + k % 4).alias("JobSatisfaction"),
        _int(1 + ck % 4).alias("EnvironmentSatisfaction"),
        _int(1 + (k + ck) % 4).alias("RelationshipSatisfaction"),
        F.when(k % 11 == 0, F.lit(None).cast("int"))
         .otherwise(_int(1 + (3 * ck + k) % 4)).alias("WorkLifeBalance"),
        F.lit(80).alias("StandardHours"),
        F.coalesce(F.col("n_lines"), F.lit(0)).alias("n_lines"),
        F.col("qty"),
        F.col("max_discount"),
    )


def label_view(o: DataFrame) -> DataFrame:
    """``o_lab``: id and 0/1 label."""
    return o.select("id", F.when(F.col("Attrition") == "Yes", 1).otherwise(0).alias("y"))


def score_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View C: two synthetic models' scores per id (m1 tie-heavy, m2 label-shifted)."""
    lab = label_view(employee_view(spark, sf_dir))
    base = ((F.col("id") * 7919) % 10000) / lit_d(1e4)
    m1 = lab.select("id", "y", F.lit("m1").alias("model"), base.alias("p"))
    m2 = lab.select("id", "y", F.lit("m2").alias("model"),
                    (lit_d(0.7) * base + lit_d(0.3) * F.col("y")).alias("p"))
    return m1.unionByName(m2)


# Oracle twins (DuckDB and Spark SQL accept them unchanged).
O_SQL = """SELECT o.o_orderkey AS id,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS Attrition,
  c.c_mktsegment AS Department, o.o_orderpriority AS JobRole, r.r_name AS Region,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS OverTime,
  CAST(18 + (o.o_orderkey * 31) % 43 AS INT) AS Age,
  CAST(floor(o.o_totalprice / 25) AS INT) AS MonthlyIncome,
  CAST(o.o_custkey % 15 AS INT) AS YearsAtCompany,
  CAST(o.o_custkey % 15 + o.o_orderkey % 12 AS INT) AS TotalWorkingYears,
  CAST(floor((o.o_custkey % 15) * 0.6e0) AS INT) AS YearsInCurrentRole,
  CAST(floor((o.o_custkey % 15) * 0.5e0) AS INT) AS YearsWithCurrManager,
  CAST(o.o_orderkey % 7 AS INT) AS YearsSinceLastPromotion,
  CAST(o.o_orderkey % 10 AS INT) AS NumCompaniesWorked,
  CAST(1 + o.o_orderkey % 4 AS INT) AS JobSatisfaction,
  CAST(1 + o.o_custkey % 4 AS INT) AS EnvironmentSatisfaction,
  CAST(1 + (o.o_orderkey + o.o_custkey) % 4 AS INT) AS RelationshipSatisfaction,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + (3 * o.o_custkey + o.o_orderkey) % 4 AS INT) END AS WorkLifeBalance,
  80 AS StandardHours,
  COALESCE(l.n_lines, 0) AS n_lines, l.qty AS qty, l.max_discount AS max_discount
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, max(l_discount) AS max_discount
           FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey"""

O_LAB_SQL = "SELECT id, CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END AS y FROM o"

C_SQL = """SELECT id, y, 'm1' AS model, ((id * 7919) % 10000) / 1e4 AS p FROM o_lab
UNION ALL
SELECT id, y, 'm2' AS model, 0.7e0 * (((id * 7919) % 10000) / 1e4) + 0.3e0 * y AS p FROM o_lab"""


def with_views(body: str, score: bool = False) -> str:
    """Prefix ``body`` with the CTEs ``o`` (and ``o_lab``, ``c`` when ``score``)."""
    ctes = [f"o AS ({O_SQL})"]
    if score:
        ctes += [f"o_lab AS ({O_LAB_SQL})", f"c AS ({C_SQL})"]
    body = body.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body


def duplicates_view(o: DataFrame) -> DataFrame:
    """O plus exact copies (id % 50 = 0) and id collisions with another Department.

    ``src`` is the ingest order: 0 originals, 1 exact copies, 2 collisions.
    """
    base = o.withColumn("src", F.lit(0))
    sel = o.filter(F.col("id") % 50 == 0)
    return (base.unionByName(sel.withColumn("src", F.lit(1)))
                .unionByName(sel.withColumn("Department", F.lit("OTHER")).withColumn("src", F.lit(2))))


def bad_label_view(o: DataFrame) -> DataFrame:
    """O with Attrition replaced by "Maybe" where id % 97 = 0."""
    return o.withColumn("Attrition", F.when(F.col("id") % 97 == 0, F.lit("Maybe"))
                        .otherwise(F.col("Attrition")))


DUP_SQL = """SELECT *, 0 AS src FROM o
UNION ALL SELECT *, 1 AS src FROM o WHERE id % 50 = 0
UNION ALL SELECT * REPLACE ('OTHER' AS Department), 2 AS src FROM o WHERE id % 50 = 0"""
