"""Operator 6: removal of lines that are spread over many sites.

A HyperLogLog sketch of the sites is built per line hash and merged by aggregation (partial
sketches per task, so a line in a third of all rows costs one sketch per task).  Lines whose
estimate is near the threshold get an exact distinct count; the others are decided by the estimate.
Spread lines are removed from every document, whatever their share of it.  Only a text that itself
occurs on several sites and consists of spread lines for ``most_share`` of its characters or more is
taken for a copy: its lines may be spread by its own copies, so it loses just those that are still
spread when every distinct text counts for one site (its smallest), and the rest is left for
near-duplicate removal.

Lines are what stands between ``\\n``; they are compared without surrounding white space, blank
lines are never counted or removed.

Defined cases: a null text stays null, an empty one empty; null sites count as one site; repeated
rows count once per site; a document with all lines kept is unchanged byte for byte; an empty table
gives no rows.  All other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.store import staged

MIN_SITES = 10
MOST_SHARE = 0.5
LG_K = 12
BAND = 2           # estimates this close to the threshold are counted exactly (the error of a
                   # sketch with 2^12 registers is far below one at such counts)
BROADCAST_LINES = 100_000
BLANKS = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _site(site_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``key, sites``: md5 of the trimmed lines found on at least ``min_sites`` sites; ``sites`` is
    exact near the threshold and the sketch's estimate above it."""
    lines = (docs.select(_site(site_col).alias("site"), F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line"))
             .select("site", _trimmed(F.col("line")).alias("line")).filter("line <> ''")
             .select(F.md5("line").alias("key"), "site"))
    rough = staged(lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
                   .filter(F.col("sites") >= min_sites - BAND), "line-spread")
    near = rough.filter(F.col("sites") <= min_sites + BAND).select("key")
    exact = (lines.join(near, "key", "left_semi").distinct()
             .groupBy("key").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites))
    return rough.filter(F.col("sites") > min_sites + BAND).unionByName(exact)


def _proven(hits: DataFrame, docs: DataFrame, few: bool, min_sites: int, most_share: float, text_col: str, site_col: str) -> DataFrame:
    """``hits(tkey, chars, hit)`` without the lines of copies that only the copies themselves spread;
    ``few`` says that the spread lines may be broadcast."""
    small = F.broadcast if few else (lambda lines: lines)
    texts = (docs.select(F.md5(F.col(text_col).cast("string")).alias("tkey"), _site(site_col).alias("site"))
             .groupBy("tkey").agg(F.min("site").alias("site"), F.max("site").alias("last")))
    gone = F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x["len"])
    known = staged(hits.join(texts, "tkey").select(
        "tkey", "site", "hit", ((F.col("site") < F.col("last")) & (gone >= most_share * F.col("chars"))).alias("copy")), "line-texts")
    copies = known.filter("copy").select("tkey", F.explode("hit").alias("x")).select("tkey", "x", F.col("x.key").alias("key"))
    proven = (known.select("site", F.explode(F.array_distinct(F.col("hit")["key"])).alias("key")).distinct()
              .join(small(copies.select("key").distinct()), "key", "left_semi")
              .groupBy("key").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites))
    return (known.filter("not copy").select("tkey", "hit")
            .unionByName(copies.join(small(proven), "key", "left_semi").groupBy("tkey").agg(F.collect_list("x").alias("hit"))))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, most_share: float = MOST_SHARE,
                        text_col: str = "text", site_col: str = "source", report: str | None = None) -> DataFrame:
    """``docs`` with spread lines taken out of the text.  ``report`` names a struct column
    ``n_lines, n_removed`` to add."""
    text = F.col(text_col).cast("string")
    spread = staged(spread_lines(docs, min_sites, text_col, site_col).select("key"), "line-list")
    few = spread.count() <= BROADCAST_LINES
    if few:
        spread = F.broadcast(spread)  # at most BROADCAST_LINES hashes
    parts = (docs.select(F.md5(text).alias("tkey"), F.char_length(text).alias("chars"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
             .select("tkey", "chars", "pos", F.char_length("line").alias("len"), F.md5(_trimmed(F.col("line"))).alias("key")))
    hits = staged(parts.join(spread, "key", "left_semi").groupBy("tkey", "chars")
                  .agg(F.collect_set(F.struct("pos", "len", "key")).alias("hit")), "line-hits")
    hits = staged(_proven(hits, docs, few, min_sites, most_share, text_col, site_col), "line-proven")
    names = docs.columns
    rows = (docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.md5(text).alias("tkey"))
            .join(hits, "tkey", "left"))
    text = F.col("row").getField(text_col).cast("string")
    apply = F.col("hit").isNotNull()
    where = F.map_from_arrays(F.col("hit")["pos"], F.col("hit")["len"])
    rest = F.concat_ws("\n", F.filter(F.split(text, "\n"), lambda x, i: ~F.map_contains_key(where, i)))
    out = [F.when(apply, rest).otherwise(F.col("row").getField(c)).alias(c) if c == text_col
           else F.col("row").getField(c).alias(c) for c in names]
    if report:
        out.append(F.struct(
            F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"),
            F.when(apply, F.size("hit")).otherwise(0).alias("n_removed")).alias(report))
    return rows.select(*out)
