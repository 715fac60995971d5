"""Corpus pipeline over ``documents``: language filter, boilerplate lines, near duplicates, source mix,
packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it kept, and
returns a DataFrame; ``run`` writes each result as Parquet below ``spark.checkpoint.dir`` and reads
it again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrlens.llm import langid, line_dedup, mixing, ngram_join, packing
from hrlens.llm.store import free_name, library_on_workers, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects (no letters, or unlike every language)."""
    library_on_workers(spark)
    return langid.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines spread over many sources out of the texts; no document is dropped."""
    name = free_name(docs, "found")
    out = line_dedup.remove_spread_lines(docs, report=name)
    changed = F.col(name)["n_removed"] > 0
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: five words, Jaccard 0.8."""
    library_on_workers(spark)
    return ngram_join.keep_one(docs, k=5, num=4, den=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs into sequences of 4096; one row per piece."""
    library_on_workers(spark)
    return packing.pack(docs)


STAGES = [
    ("language identification", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: Language models and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
