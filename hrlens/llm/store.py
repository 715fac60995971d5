"""Intermediate tables in the cluster's shared folder, and connected components on them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import hrlens
from hrlens.session import checkpoint_dir


def library_on_workers(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the library when it is not installed: its folder
    goes on the search path that Spark hands to them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(hrlens.__file__)))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage (a lost executor costs a read, not a recomputation) and pins values
    that depend on how a scan was split.
    """
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/hrlens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _rank(node: Column) -> Column:
    return F.struct(F.xxhash64(node, F.lit(1)).alias("h"), node.alias("v"))


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node with an edge.

    Each round points every node at the neighbour (or itself) with the smallest hash and contracts
    the edges along these pointers.  A star is done after two rounds, since its centre takes the
    smallest hash of all; hash order instead of id order makes the expected shrinkage a constant
    factor for chains too.  All steps are aggregates and joins; nothing is collected.  ``root`` is
    any node of the component, the same for all its nodes.
    """
    live = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .filter("a <> b").distinct(), f"{label}-edges")
    found = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(_rank(F.col("b"))).alias("m"))
                     .select("node", F.least(F.col("m"), _rank(F.col("node")))["v"].alias("to")), f"{label}-hop")
        left = hop.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = hop.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        live = staged(live.join(left, "a").join(right, "b")
                      .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                      .filter("a <> b").distinct(), f"{label}-edges")
        if found is None:
            found = hop.select("node", F.col("to").alias("root"))
        else:
            step = hop.select(F.col("node").alias("root"), "to")
            found = found.join(step, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root"))
    if found is None:
        node = edges.select(F.col("a").alias("node"))
        return node.select("node", F.col("node").alias("root")).limit(0)
    return staged(found, f"{label}-roots")
