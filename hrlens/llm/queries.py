"""Registered queries of the training-data operators: ``opN_<name>(spark, sf_dir)``.

Each applies its operator with production parameters to its whole table and returns the digest
columns of its full result.  ``ORACLE`` has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrlens.llm import (ego_join, langid, line_dedup, main_text, mixing, ngram_join, packing, periodic, repetition,
                        token_counts, tool_calls, url_filter, whitening)
from hrlens.llm.store import library_on_workers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    library_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine 0.98 within equal labels."""
    return ego_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(_table(spark, sf_dir, "documents"))


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    got = F.col(rows.columns[-1])
    return rows.select("doc_id", *[got[c].alias(c) for c in ("size", "source_size", "target", "taken")])


def op6_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_spread_lines(_table(spark, sf_dir, "documents"), report="found")
    return rows.select("doc_id", F.col("found.n_lines").cast("long").alias("n_lines"),
                       F.col("found.n_removed").cast("long").alias("n_removed"),
                       F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, Jaccard 0.85, all documents."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 0, "maximum": 8},
        "context": {"type": "string"}}},
    "lookup": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 400}}},
    "summarise": {"type": "object", "required": ["query", "style"], "properties": {"style": {"enum": ["short", "long"]}}},
}


def tool_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) derived from whole conversations: every assistant turn is a call that may use
    the assistant's call before (or, rarely, the one after it: a cycle), every user turn the result of the call before it, any other turn a
    result without a call.  A fifth of the calls is recorded late, a few have broken arguments."""
    ident = lambda back: F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn") - back)
    pick = F.crc32(ident(0))
    name = F.element_at(F.array(*[F.lit(x) for x in ("search", "lookup", "summarise", "draw")]), (pick % 4 + 1).cast("int"))
    args = F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") % 12 - 1).alias("limit"),
                              F.when(F.col("turn") > 2, F.struct(F.when(pick % 53 == 0, ident(-2)).otherwise(ident(2)).alias("$ref"))).alias("context")))
    calls = conversations.filter("role = 'assistant'").select(
        "conv_id", ident(0).alias("call_id"), (F.col("turn") + F.when(pick % 5 == 0, 4).otherwise(0)).alias("turn"),
        name.alias("name"), F.when(pick % 97 == 0, F.substring(args, 1, 20)).otherwise(args).alias("arguments"))
    results = conversations.filter("role is null or role <> 'assistant'").select(
        "conv_id", F.when(F.col("role") == "user", ident(1)).otherwise(F.concat(F.lit("other_"), ident(0))).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_events(_table(spark, sf_dir, "conversations")), SCHEMAS)




def url_lists(pages: DataFrame) -> DataFrame:
    """A dated history of list entries derived from the hosts and first path segments of all pages."""
    host = url_filter.host_of(F.col("url"))
    hosts = pages.select(host.alias("host"), F.element_at(F.split(url_filter.path_of(F.col("url")), "/"), 2).alias("seg")).filter("host <> ''").distinct()
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    day = lambda d: F.expr("date'2024-01-01'") + d

    def events(rows: DataFrame, name: str, allow: bool, kind: str, steps: list) -> DataFrame:
        h = number(F.col("pattern"))
        made = F.array(*[F.struct(F.lit(action).alias("action"), day(at(h)).cast("timestamp").alias("ts"), cond(h).alias("use")) for action, at, cond in steps])
        return (rows.distinct().select("pattern", F.explode(made).alias("e")).filter("e.use").select(
            F.lit(name).alias("list"), F.lit(allow).alias("allow"), F.lit(kind).alias("kind"), "pattern",
            F.col("e.action").alias("action"), F.col("e.ts").alias("ts")))

    always = lambda h: F.lit(True)
    per_host = events(hosts.select(F.col("host").alias("pattern")), "spam", False, "host", [
        ("add", lambda h: h % 300, always), ("remove", lambda h: h % 300 + 30, lambda h: h % 2 == 0),
        ("add", lambda h: h % 300 + 60, lambda h: h % 4 == 0)])
    labels = F.split("host", r"\.")
    domains = hosts.filter(F.size(labels) > 3).select(F.array_join(F.slice(labels, 2, 20), ".").alias("pattern"))
    per_domain = events(domains, "adult", False, "domain", [
        ("add", lambda h: h % 200, always), ("remove", lambda h: h % 200 + 90, always)])
    prefixes = hosts.filter("seg <> ''").select(F.concat("host", F.lit("/"), "seg").alias("pattern"))
    per_prefix = events(prefixes, "trusted", True, "prefix", [
        ("add", lambda h: h % 250, lambda h: h % 3 == 0), ("remove", lambda h: h % 250 + 45, lambda h: h % 3 == 0)])
    return per_host.unionByName(per_domain).unionByName(per_prefix)


def op9_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(page_id * 7919 % 365 as int), 0, 0, page_id % 86400)")
    rows = url_filter.filter_captures(pages.withColumn("fetched", fetched), url_lists(pages))
    got = F.col(rows.columns[-1])
    return rows.select("page_id", got["blocked"].alias("blocked"), got["n_block"].alias("n_block"),
                       got["n_allow"].alias("n_allow"), F.array_join(got["rules"], ",").alias("rules"))


def op10_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with periodic words planted: where the id's crc32 ``h`` is divisible by 10,
    every word from ``a = g % n`` on becomes the word ``a + (i - a) % p``, with ``g = h div 10``."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("w"))
    rows = rows.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    rows = rows.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = F.array_join(F.transform("w", word), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.periodic_runs(planted_periods(_table(spark, sf_dir, "documents")))
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.aggregate("runs", none, better)
    return (rows.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` fits a long up to some 10^6 vectors of this spread; it is null beyond (the operator's
    decimal has no such bound)."""
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_epsilon_grid_join, op2_repetition_coverage, op3_tag_path_ratios, op4_best_fit_packing, op5_source_mixing,
        op6_site_spread_lines, op7_ngram_jaccard_join, op8_tool_call_linking, op9_temporal_url_filter, op10_kneser_ney_langid,
        op11_periodic_runs, op12_token_counts, op13_whitening)
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op1_epsilon_grid_join": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM e JOIN comp USING (vec_id) LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id""",
    "op5_source_mixing": f"""
WITH d AS (SELECT doc_id, text, source, {_WORDS} AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
t AS (SELECT *, sum(2 * source_size) OVER o AS caps, sum(w) OVER o AS used, sum(source_size) OVER () AS total, sum(w) OVER () AS weights
      FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source ROWS UNBOUNDED PRECEDING)),
cand AS (SELECT (1.5 * total)::DOUBLE / weights AS level FROM t UNION SELECT (1.5 * total - caps)::DOUBLE / (weights - used) FROM t WHERE weights > used),
lvl AS (SELECT max(level) AS level FROM cand
        WHERE abs((SELECT sum(least(w * level, 2.0 * source_size)) FROM s) - (SELECT 1.5 * max(total) FROM t)) < 1e-6 * (SELECT max(total) + 1 FROM t)),
g AS (SELECT source, source_size, least(w * level, 2.0 * source_size)::DOUBLE AS target FROM s, lvl),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('1:' || coalesce(d.doc_id::VARCHAR, md5(d.text), '')), 1, 13))::BIGINT / 4503599627370496.0 AS coin
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + (coin < rate - floor(rate))::INT)::BIGINT AS taken FROM c""",
    "op6_site_spread_lines": f"""
WITH d AS (SELECT doc_id, text, source, row_number() OVER () AS rid, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT rid, coalesce('=' || source, 'null') AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
spread AS (SELECT trim(line, {_BLANKS}) AS line FROM l WHERE trim(line, {_BLANKS}) <> ''
           GROUP BY 1 HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.*, s.line IS NOT NULL AS hit FROM l LEFT JOIN spread s ON trim(l.line, {_BLANKS}) = s.line),
k AS (SELECT d.text, min(coalesce('=' || source, 'null')) AS site, max(coalesce('=' || source, 'null')) AS last FROM d GROUP BY d.text),
h AS (SELECT d.text, list({{'line': trim(m.line, {_BLANKS}), 'pos': m.pos}}) AS hits, sum(length(m.line)) AS gone
      FROM m JOIN (SELECT text, min(rid) AS rid FROM d GROUP BY text) d USING (rid) WHERE m.hit GROUP BY d.text),
g AS (SELECT h.text, k.site, unnest(h.hits) AS x, k.site < k.last AND h.gone >= 0.5 * length(h.text) AS copy FROM h JOIN k USING (text)),
proven AS (SELECT x.line AS line FROM g GROUP BY 1 HAVING count(DISTINCT site) >= 10),
cut AS (SELECT text, list(x.pos) AS pos FROM g WHERE NOT copy OR x.line IN (SELECT line FROM proven) GROUP BY text),
f AS (SELECT d.doc_id, d.text, d.lines, c.pos, CASE WHEN c.pos IS NULL THEN d.text ELSE
             coalesce(array_to_string([l FOR l, i IN d.lines IF NOT list_contains(c.pos, i)], chr(10)), '') END AS rest
      FROM d LEFT JOIN cut c ON c.text = d.text)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(pos), 0) AS n_removed, length(rest) AS n_chars, md5(rest) AS text_md5 FROM f""",
    "op9_temporal_url_filter": r"""
WITH p AS (SELECT page_id, url, timestamp '2024-01-01' + to_days((page_id * 7919 % 365)::INT) + to_seconds(page_id % 86400) AS t,
                  lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
                  list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS segs
           FROM pages),
h AS (SELECT DISTINCT host AS pattern, ('0x' || substr(md5(host), 1, 4))::INT AS n FROM p WHERE host <> ''),
dm AS (SELECT DISTINCT array_to_string(string_split(host, '.')[2:], '.') AS pattern FROM p WHERE len(string_split(host, '.')) > 3),
dn AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT AS n FROM dm),
px AS (SELECT DISTINCT host || '/' || segs[1] AS pattern FROM p WHERE host <> '' AND len(segs) > 0),
pn AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT AS n FROM px),
rules AS (
  SELECT 'spam host:' || pattern AS rule, false AS allow, 'h' AS kind, pattern, n % 300 AS a, CASE WHEN n % 2 = 0 THEN n % 300 + 30 END AS b FROM h
  UNION ALL SELECT 'spam host:' || pattern, false, 'h', pattern, n % 300 + 60, NULL FROM h WHERE n % 4 = 0
  UNION ALL SELECT 'adult domain:' || pattern, false, 'd', pattern, n % 200, n % 200 + 90 FROM dn
  UNION ALL SELECT 'trusted prefix:' || pattern, true, 'p', pattern, n % 250, n % 250 + 45 FROM pn WHERE n % 3 = 0),
m AS (SELECT DISTINCT p.page_id, r.rule, r.allow FROM p JOIN rules r
      ON (CASE r.kind WHEN 'h' THEN p.host = r.pattern WHEN 'd' THEN p.host = r.pattern OR ends_with(p.host, '.' || r.pattern)
               ELSE len(p.segs) > 0 AND p.host || '/' || p.segs[1] = r.pattern END)
     AND p.t >= timestamp '2024-01-01' + to_days(r.a::INT) AND (r.b IS NULL OR p.t < timestamp '2024-01-01' + to_days(r.b::INT)))
SELECT p.page_id, coalesce(count(*) FILTER (WHERE NOT m.allow) > 0 AND count(*) FILTER (WHERE m.allow) = 0, false) AS blocked,
       count(*) FILTER (WHERE NOT m.allow) AS n_block, count(*) FILTER (WHERE m.allow) AS n_allow,
       coalesce(string_agg(m.rule, ',' ORDER BY m.rule), '') AS rules
FROM p LEFT JOIN m USING (page_id) GROUP BY p.page_id""",
}
