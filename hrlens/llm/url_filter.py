"""Operator 9: URL filter lists with a history, evaluated as of each capture's fetch time.

List entries are dated events: ``add`` opens a rule, ``remove`` closes it.  Each rule's events
become disjoint validity intervals.  A capture is looked up under the keys that its URL can match
(its exact host, the domains above it, its path prefixes): per list and key one as-of probe finds
the last interval that starts at or before the fetch time, and its end decides.

The probe is an equi-join on (key, time bucket).  A rule's row for a bucket holds the intervals that
start in it and the last one that started before, so a capture meets one row per rule of its key,
however long the rule's history and however many captures the key has.  What is ordered per rule is
one row per bucket, never its events or captures.  A (key, bucket) with very many captures is split
by the adaptive skew join.  Everything is DataFrame expressions and joins.

Rules: ``host`` matches one host, ``domain`` a host and all below it, ``prefix`` a host and the
leading path segments.  A capture is blocked when a rule of a blocking list is active and none of
an allowing list is.

Defined cases: of an ``add`` and a ``remove`` at the same time the ``add`` wins; repeated events
count once; an interval holds its start and not its end; entries with a null list, kind, pattern,
action or time are ignored; captures with a null time, a null URL or one without a host match
nothing and are not blocked; repeated captures are evaluated once and returned as often as they
occur; hosts of any number of labels are read as far up as a rule can reach; empty tables give no
rows or no matches.  Other columns of the captures are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrlens.llm.store import free_name

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port or trailing dot; '' if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


RULE = ["list", "allow", "key"]
BUCKET_SECONDS = 86400


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def bucketed_intervals(entries: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``list, allow, key, bucket, spans`` from ``list, allow, kind, pattern, action, ts``: per rule and
    time bucket with events the sorted validity intervals (open end: null) that start in it."""
    pattern = F.when(F.col("kind") == "prefix", F.rtrim(F.col("pattern"), F.lit("/"))).otherwise(F.rtrim(F.lower("pattern"), F.lit(".")))
    events = (entries.filter("list is not null and kind is not null and pattern is not null and ts is not null")
              .filter(F.col("action").isin("add", "remove"))
              .groupBy("list", F.coalesce("allow", F.lit(False)).alias("allow"),
                       F.concat("kind", F.lit(":"), pattern).alias("key"), "ts")
              .agg(F.bool_or(F.col("action") == "add").alias("opens"))
              .withColumn("bucket", _bucket(F.col("ts"), bucket_seconds)))
    inside = Window.partitionBy(*RULE, "bucket").orderBy("ts")
    runs = (events.withColumn("until", F.lead("ts").over(inside))
            .groupBy(*RULE, "bucket").agg(
                F.min("ts").alias("first"),
                F.sort_array(F.collect_list(F.when(F.col("opens"), F.struct(F.col("ts").alias("valid_from"), F.col("until").alias("valid_to"))))).alias("spans")))
    # the last event of a bucket holds until the first one of the rule's next bucket
    after = F.lead("first").over(Window.partitionBy(*RULE).orderBy("bucket"))
    return (runs.withColumn("after", after)
            .select(*RULE, "bucket", F.transform("spans", lambda s: F.struct(
                s["valid_from"].alias("valid_from"), F.coalesce(s["valid_to"], F.col("after")).alias("valid_to"))).alias("spans")))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, allow, key, valid_from, valid_to`` (open end: null) from
    ``list, allow, kind, pattern, action, ts``."""
    return bucketed_intervals(entries).select(*RULE, F.inline("spans"))


def keys_of(url: Column, depth: int, labels_deep: int) -> Column:
    """All rule keys a URL can match; ``depth`` is the deepest path prefix of any rule and
    ``labels_deep`` the most labels of any domain rule."""
    labels = F.split(host_of(url), r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - F.lit(labels_deep - 1))
    domains = F.transform(F.sequence(first, F.size(labels)),
                          lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    reach = F.least(F.size(parts), F.lit(depth))
    prefixes = F.transform(F.sequence(F.lit(0), reach), lambda i: F.concat(
        F.lit("prefix:"), F.array_join(F.concat(F.array(host_of(url)), F.slice(parts, F.lit(1), i)), "/")))
    every = F.concat(F.array(F.concat(F.lit("host:"), host_of(url))), domains, prefixes)
    return F.when(host_of(url) != "", every).otherwise(F.array().cast("array<string>"))


def _probes(keyed: DataFrame, valid: DataFrame) -> DataFrame:
    """Per rule and bucket with captures: ``spans`` with the last interval that started before the
    bucket (if it reaches into it) ahead of those that start in it."""
    wanted = (keyed.select("key", "bucket").distinct().join(valid.select(*RULE).distinct(), "key")
              .select(*RULE, "bucket", F.lit(True).alias("asked"), F.lit(None).cast(valid.schema["spans"].dataType).alias("spans")))
    line = (wanted.unionByName(valid.withColumn("asked", F.lit(False)))
            .groupBy(*RULE, "bucket").agg(F.bool_or("asked").alias("asked"), F.max("spans").alias("spans")))
    earlier = Window.partitionBy(*RULE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("spans") > 0, F.element_at("spans", -1))
    return (line.withColumn("before", F.last(last, ignorenulls=True).over(earlier)).filter("asked")
            .select(*RULE, "bucket", F.concat(F.filter(F.array("before"), lambda s: s.isNotNull()),
                                              F.coalesce("spans", F.array().cast(valid.schema["spans"].dataType))).alias("spans"))
            .filter(F.size("spans") > 0))


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched",
                    bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``captures`` with a struct column ``url_filter``: ``blocked``, ``n_block``, ``n_allow`` (active
    rules matched) and ``rules`` (their sorted names)."""
    valid = bucketed_intervals(entries, bucket_seconds)
    kind = lambda k: F.col("key").startswith(k)
    deepest, most_labels = valid.agg(
        F.coalesce(F.max(F.when(kind("prefix:"), F.size(F.split("key", "/")) - 1)), F.lit(0)),
        F.coalesce(F.max(F.when(kind("domain:"), F.size(F.split("key", r"\.")))), F.lit(1))).first()
    asked = (captures.select(F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("t"))
             .filter("url is not null and t is not null").distinct())
    keyed = asked.select("url", "t", _bucket(F.col("t"), bucket_seconds).alias("bucket"),
                         F.explode(F.array_distinct(keys_of(F.col("url"), deepest, most_labels))).alias("key"))
    # filter keeps the order, so its last element is the last interval that starts at or before t
    held = F.try_element_at(F.filter("spans", lambda s: s["valid_from"] <= F.col("t")), F.lit(-1))
    active = (keyed.join(_probes(keyed, valid), ["key", "bucket"]).withColumn("held", held)
              .filter(F.col("held").isNotNull() & (F.col("held.valid_to").isNull() | (F.col("t") < F.col("held.valid_to")))))
    found = active.groupBy("url", "t").agg(
        F.count_if(~F.col("allow")).alias("n_block"), F.count_if("allow").alias("n_allow"),
        F.sort_array(F.collect_set(F.concat("list", F.lit(" "), "key"))).alias("rules"))
    name = free_name(captures, "url_filter")
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"))
    row_url, row_time = F.col("row").getField(url_col).cast("string"), F.col("row").getField(time_col)
    none = F.lit(0).cast("long")
    return (rows.join(found, (row_url == F.col("url")) & (row_time == F.col("t")), "left")
            .select(*[F.col("row").getField(c).alias(c) for c in captures.columns],
                    F.struct(((F.coalesce("n_block", none) > 0) & (F.coalesce("n_allow", none) == 0)).alias("blocked"),
                             F.coalesce("n_block", none).alias("n_block"), F.coalesce("n_allow", none).alias("n_allow"),
                             F.coalesce("rules", F.array().cast("array<string>")).alias("rules")).alias(name)))
