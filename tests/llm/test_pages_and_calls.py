"""Operators 3, 8 and 9."""
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hrlens.llm import main_text as mt
from hrlens.llm import queries, tool_calls, url_filter

ARTICLE = ["A plain heading", "First paragraph, long enough to look like text; it has commas, and two sentences. Yes, it has.",
           "Short one.", "Another & longer paragraph with “quotes”, an <b>, and a no-break space. It goes on for a while, as text does.",
           "The end of it, finally."]


def _p(x):
    return x.replace("&", "&amp;").replace("<", "&lt;")


BODY = f"<h1>{_p(ARTICLE[0])}</h1>" + "".join(f"<p>\n {_p(x).replace(' ', '  ', 2)} " for x in ARTICLE[1:])
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news sport weather more".split()) + "</ul>"
LONG = "This is quite a long sentence, with punctuation, that belongs to something else. It has, well, a second one."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><script>var x = '</p><p>no';</script></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>&copy; x</footer></body></html>",
    f"<body><header><h1>Site</h1>{MENU}</header><main>{BODY}</main><aside><p>{LONG}</p><p>{LONG}</p></aside>",
    f'<body><div class="cookie-notice"><p>{LONG}</p></div><div id="content">{BODY}</div><div class="sidebar"><p>{LONG}</p></div><div id="footer"><p>{LONG}</p></div>',
    f'<body><div class="topMenu">{MENU}</div><div class="post">{BODY}</div><section class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>',
    f'<body><table><tr><td>{MENU}</td><td><div>{BODY}</div></td></tr></table><form><p>{LONG}</p><textarea>{LONG}</textarea></form>',
    f'<body><div class="wrap"><div>{MENU}</div><div class="text">{BODY}<div class="ad"><p>{LONG}</p></div></div><div role="complementary"><p>{LONG}</p></div></div><!-- {LONG} -->',
    f'<article><header><div class="x">{BODY}</div></header></article><div style="display: none"><p>{LONG}</p></div><p hidden>{LONG}</p>',
])
def test_main_text_of_layouts(page):
    assert mt.main_text(page) == "\n\n".join(ARTICLE)


LINKS = "<ul>" + "".join(f'<li><a href="/{w}">{w} of the references</a></li>' for w in ("first", "second")) + "</ul>"
REFERENCES = ["first of the references", "second of the references"]


@pytest.mark.parametrize("page,more", [
    (f'<body><nav>{MENU}</nav><div class="post"><h1>{ARTICLE[0]}</h1><div class="body">{BODY[len(ARTICLE[0]) + 9:]}</div></div>', []),
    (f'<body><div>{MENU}</div><div><div>{BODY}{"<p>" + LONG * 20}</div><div><p>{LONG}</p></div></div>', [LONG * 20, LONG]),
    (f'<body><div>{MENU}</div><div class="entry">{BODY}{LINKS}</div><div class="footer">{LINKS}</div>', REFERENCES),
    (f'<body><div>{MENU}</div><div><div>{BODY}</div><div><p>{LONG}</p></div>{LINKS}</div>', [LONG, *REFERENCES]),
    (f'<main><div class="post"><article>{BODY}</article></div><article><h2><a href="x">Another</a></h2></article></main>', []),
])
def test_main_text_is_whole(page, more):
    assert mt.main_text(page) == "\n\n".join([*ARTICLE, *more])


# pages whose class names mean nothing and that have no article: only the paths' scores tell the text
MORE = [f"Paragraph {i} of the text proper, with a clause or two; it says something, at some length, and then it stops." for i in range(12)]
TEXT = f"<p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p>" + "".join(f"<p>{x}</p>" for x in MORE)
WANTED = [*ARTICLE[1:3], *MORE]
NOTE = "<p>We keep small files on your device, so that we know you.</p><p>More about it.</p>"
SAID = "".join(f"<div class='q{c}'><p>{w}</p></div>" for c, w in zip("ab", ("Nice read!", "I don't agree, sorry.")))


@pytest.mark.parametrize("page,want", [
    (f'<body><div class="k1"><p>{LONG}</p></div><div class="x7"><h1>A heading</h1>{TEXT}</div>', ["A heading", *WANTED]),
    (f'<body><div class="k1">{NOTE}</div><div class="x7"><h1>A heading</h1>{TEXT}</div><div class="k2">{SAID}</div>', ["A heading", *WANTED]),
    (f'<body><div class="w"><div class="x7">{TEXT}</div><div class="k"><h3>Elsewhere</h3><p>{LONG}</p>{MENU}</div></div>', WANTED),
    (f'<body><div class="w"><div class="m">{MENU}</div><div class="x7">{TEXT}<div class="k"><p>Buy our lamps, they are cheap.</p></div><p>{MORE[0]}</p></div></div>',
     [*WANTED, MORE[0]]),
    (f'<body><div class="w"><div class="h"><h1>A heading</h1></div><div class="x7">{TEXT}<h2>Sources</h2>{LINKS}</div></div><div class="z"><p>{LONG}</p></div>',
     ["A heading", *WANTED, "Sources", *REFERENCES]),
    (f'<body><table class="g"><tr><td class="k">{MENU}<p>{LONG}</p></td><td class="x"><h1>A heading</h1>{TEXT}</td></tr></table>', ["A heading", *WANTED]),
])
def test_path_scores_select_the_text(page, want, monkeypatch):
    assert mt.main_text(page) == "\n\n".join(want)
    monkeypatch.setattr(mt, "selected_paths", lambda blocks: {(b.node.path, b.node.other) for b in blocks})
    assert mt.main_text(page) != "\n\n".join(want)


def test_scores_and_not_marks_alone_decide():
    page = f'<body><nav><p>{LONG}</p></nav><div>{TEXT}</div><aside><p>{LONG}</p></aside>'
    assert mt.main_text(page) == "\n\n".join(WANTED)
    blocks = mt.blocks_of(page)
    score = mt.path_scores(blocks)
    assert {k for k in score if not k[1]} == mt.selected_paths(blocks) and {score[k] for k in score if k[1]} == {0}


def test_main_text_of_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "just words"), (4, "u", "<p>a<p>b &amp &#x41;&bogus; <br>c"), (5, "u", "<nav>menu</nav>"),
             (6, "u", "<<<>>> <p <div> text. <"), (7, "u", "<script>never closed <p>x"), (7, "u", "<script>never closed <p>x"),
             (None, "u", "<p>" + "word, " * 50_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in mt.extract(df).collect()]
    assert len(got) == len(pages)
    by = {i: t for i, _, t, _ in got}
    assert by[1] == by[2] == by[5] == by[7] == "" and by[3] == "just words" and by[4] == "a\n\nb & A&bogus; c"
    assert by[None] == ("word, " * 50_000).strip()
    assert all(n == len(t) for _, _, t, n in got)
    assert mt.extract(df.limit(0)).count() == 0


def test_schema_violations_and_canonical_json():
    schema = queries.SCHEMAS["search"]
    assert tool_calls.violations({"query": "a", "limit": 3}, schema) == []
    assert tool_calls.violations({"query": "a", "limit": 3.0, "context": {"$ref": "c1"}}, schema) == []
    assert tool_calls.violations({"query": "", "limit": 9, "x": 1}, schema) == ["$.query: too short", "$.limit: above maximum", "$.x: unknown"]
    assert tool_calls.violations({"limit": True}, schema) == ["$.query: missing", "$.limit: not integer"]
    assert tool_calls.violations([1], schema) == ["$: not object"]
    assert tool_calls.canonical({"b": [1, {"z": None, "a": "é"}], "a": 1}) == '{"a":1,"b":[1,{"a":"é","z":null}]}'


def _ref(*ids):
    return json.dumps({"query": "q", "uses": [{"$ref": i} for i in ids]})


@pytest.mark.parametrize("items", [tool_calls.GROUP_ITEMS, 0])
def test_linking_and_order(spark, items):
    calls = [(1, "a", 5, "lookup", _ref("b")), (1, "b", 5, "lookup", _ref("c")), (1, "c", 7, "lookup", _ref()), (1, "d", 1, "lookup", _ref("zz")),
             (2, "a", 1, "lookup", _ref("b")), (2, "b", 2, "lookup", _ref("a")), (2, "e", 0, "lookup", _ref("b")), (2, "f", 1, "lookup", _ref()),
             (3, "s", 1, "lookup", _ref("s")), (4, "x", 3, "search", '{"query": "a", "limit": 2}'), (4, "x", 3, "search", '{"query": "a", "limit": 2}'),
             (4, "x", 9, "search", "later"), (5, None, 1, "nope", "{bad"), (5, None, 1, "nope", "{bad"), (None, "x", 1, "lookup", None)]
    results = [(1, "a", 6, "ra"), (1, "a", 8, "too late"), (4, "x", 4, None), (4, "ghost", 2, "lost"), (4, None, 2, "no name"), (None, "x", 2, "r")]
    got = tool_calls.link(spark.createDataFrame([(*c, 1) for c in calls], "conv_id long, call_id string, turn long, name string, arguments string, step int"),
                          spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), queries.SCHEMAS, items).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in got if r["conv_id"] is not None and r["call_id"] is not None}
    assert len(got) == len(by) + 2 + 1 + 1 + 1
    assert [by[1, x]["step"] for x in "cba"] == [7, 8, 9] and by[1, "a"]["status"] == "linked"
    assert json.loads(by[1, "a"]["message"])["result"] == "ra" and by[1, "b"]["status"] == "pending"
    assert by[1, "d"]["errors"] == ["unknown reference zz"] and not by[1, "d"]["valid"]
    assert [by[2, x]["cyclic"] for x in "abef"] == [True, True, True, False] and by[3, "s"]["cyclic"]
    assert by[4, "x"]["turn"] == 3 and by[4, "x"]["valid"] and by[4, "ghost"]["status"] == "orphan"
    assert {e for r in got if r["conv_id"] == 5 for e in r["errors"]} == {"$: not JSON", "unknown tool"}


def _brute_order(turns, uses):
    """Steps and cycle marks by reachability and longest paths, from their definitions."""
    def above(x):
        seen, todo = set(), list(uses[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += uses[y]
        return seen
    on = {x for x in turns if x in above(x)}
    cyclic = {x for x in turns if x in on or above(x) & on}
    step = {}

    def place(x):
        if x not in step:
            step[x] = max([turns[x] or 0, *[place(y) + 1 for y in uses[x]]])
        return step[x]
    return {x: (turns[x], True) if x in cyclic else (place(x), False) for x in turns}


@pytest.mark.parametrize("items", [tool_calls.GROUP_ITEMS, 55, 0])
def test_order_equals_brute_force_on_random_graphs(spark, items):
    rng = random.Random(4)
    calls, want = [], {}
    for conv in range(8):
        turns, uses = {}, {}
        for i in range(40):
            uses[i] = [j for j in range(i) if rng.random() < 0.05]
            turns[i] = i + (rng.randrange(0, 12) if rng.random() < 0.3 else 0)
        if conv % 2:  # cycles of one to three calls, and what hangs behind them
            for i in rng.sample(range(38), 2):
                uses[i] = [*uses[i], rng.choice([i, i + 1, i + 2])]
                uses[i + 1] = [*uses[i + 1], i]
                uses[i + 2] = [*uses[i + 2], i + 1]
        turns[7] = None if conv == 2 else turns[7]
        want |= {(conv, f"c{i}"): x for i, x in _brute_order(turns, uses).items()}
        calls += [(conv, f"c{i}", turns[i], "lookup", _ref(*[f"c{j}" for j in uses[i]])) for i in range(40)]
    got = tool_calls.link(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"),
                          spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), queries.SCHEMAS, items).collect()
    assert {(r["conv_id"], r["call_id"]): (r["step"], r["cyclic"]) for r in got} == want
    assert any(c for _, c in want.values()) and not all(c for _, c in want.values())


@pytest.mark.parametrize("items,convs", [(tool_calls.GROUP_ITEMS, 3000), (0, 60)])
def test_many_cycles_end_in_few_rounds(spark, items, convs, monkeypatch):
    written = []
    real = tool_calls.staged
    monkeypatch.setattr(tool_calls, "staged", lambda df, label: written.append(label) or real(df, label))
    calls = [(c, x, t, "lookup", _ref(y)) for c in range(convs) for x, y, t in (("a", "b", 1), ("b", "a", 2))]
    got = tool_calls.link(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"),
                          spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), queries.SCHEMAS, items)
    assert got.filter("cyclic").count() == 2 * convs
    assert written.count("tool-front") <= 4


def test_every_role_reaches_the_links(spark):
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 3, "user", "thanks"),
             (1, 4, None, "no role"), (1, 5, "tool", "other")]
    calls, results = queries.tool_events(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    assert [r["call_id"] for r in calls.collect()] == ["c1_2"]
    assert {r["turn"]: r["call_id"] for r in results.collect()} == {0: "other_c1_0", 1: "c1_0", 3: "c1_2", 4: "other_c1_4", 5: "other_c1_5"}
    linked = tool_calls.link(calls, results, queries.SCHEMAS).collect()
    assert sorted(r["status"] for r in linked) == ["linked"] + ["orphan"] * 4


def test_linking_of_nothing(spark):
    calls = spark.createDataFrame([], "conv_id long, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    assert tool_calls.link(calls, results, {}).count() == 0


@pytest.mark.parametrize("bucket", [3600 * 5, 86400, 10**9])
def test_url_lists_equal_brute_force(spark, bucket):
    day = lambda n: datetime(2024, 1, 1) + timedelta(hours=6 * n)
    rng = random.Random(9)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "xa.example.com"]
    kinds = [("host", h) for h in hosts] + [("domain", h) for h in hosts] + [("prefix", f"{h}/{p}") for h in hosts for p in ("x", "x/y", "")]
    entries = [(rng.choice("LM"), *rng.choice(kinds), rng.choice(["add", "remove"]), day(rng.randrange(20))) for _ in range(150)]
    entries = [(n, n == "M", k, p, act, t) for n, k, p, act, t in entries]
    entries += entries[:10] + [(None, False, "host", "other.org", "add", day(0)), ("L", None, "host", "late.net", "add", day(3)),
                               ("L", False, "host", "other.org", "toggle", day(0)), ("L", False, "host", None, "add", day(0))]
    urls = [f"{s}//{u}{h}{port}{p}" for s in ("http:", "HTTPS:", "") for u in ("", "me@") for h in (*hosts, "A.Example.COM.", "late.net")
            for port in ("", ":80") for p in ("", "/", "/x", "/x/y?q=/z", "/xy", "//x//y#f")]
    caps = [(i, rng.choice(urls), day(rng.randrange(-1, 22))) for i in range(400)]
    caps += [caps[0], (900, None, day(5)), (901, urls[0], None), (902, "mailto:x", day(5)), (903, "", day(5)), (None, "//late.net/" + "s/" * 3000, day(3))]

    state = {}
    for n, allow, kind, pattern, act, t in entries:
        if None not in (n, pattern) and act in ("add", "remove"):
            key = (n, bool(allow), kind, pattern.rstrip("/") if kind == "prefix" else pattern)
            state.setdefault(key, {}).setdefault(t, set()).add(act)

    def active(key, t):
        past = [x for x in state[key] if x <= t]
        return bool(past) and "add" in state[key][max(past)]

    def matches(kind, pattern, url):
        rest = url.split("//", 1)[1]
        host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
        segs = [s for s in ("/" + rest.split("/", 1)[1] if "/" in rest else "").split("#")[0].split("?")[0].split("/") if s]
        if kind == "host":
            return host == pattern
        if kind == "domain":
            return host == pattern or host.endswith("." + pattern)
        want = pattern.split("/")
        return [host, *segs][:len(want)] == want
    want = []
    for i, url, t in caps:
        hit = [k for k in state if url and "//" in url and t is not None and matches(k[2], k[3], url) and active(k, t)]
        block, allow = sum(not k[1] for k in hit), sum(k[1] for k in hit)
        want.append((i, url, t, (block > 0 and allow == 0, block, allow, sorted({f"{k[0]} {k[2]}:{k[3]}" for k in hit}))))
    cdf = spark.createDataFrame([(*c, 3) for c in caps], "page_id long, url string, fetched timestamp, url_filter int")
    edf = spark.createDataFrame(entries, "list string, allow boolean, kind string, pattern string, action string, ts timestamp")
    out = url_filter.filter_captures(cdf, edf, bucket_seconds=bucket)
    assert out.columns == ["page_id", "url", "fetched", "url_filter", "url_filter_"]
    got = [(r["page_id"], r["url"], r["fetched"], tuple(r["url_filter_"])) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.filter_captures(cdf.limit(0), edf).count() == 0
    assert {r["url_filter_"]["blocked"] for r in url_filter.filter_captures(cdf, edf.limit(0)).collect()} == {False}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_capture_meets_one_row_per_rule_however_long_the_history(spark):
    entries = spark.range(2000).selectExpr(
        "'L' list", "false allow", "'host' kind", "'hot.org' pattern", "if(id % 2 = 0, 'add', 'remove') action",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int) * 5) ts")
    captures = spark.range(3000).selectExpr("id", "'http://hot.org/' || id url", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id * 3 as int), 30) fetched")
    valid = url_filter.intervals(entries).collect()
    assert len(valid) == 1000 and all((r["valid_to"] - r["valid_from"]) == timedelta(hours=5) for r in valid)
    out = url_filter.filter_captures(captures, entries)
    keyed = captures.select("url", F.col("fetched").alias("t"), url_filter._bucket(F.col("fetched"), 86400).alias("bucket"), F.lit("host:hot.org").alias("key"))
    probes = url_filter._probes(keyed, url_filter.bucketed_intervals(entries))
    assert probes.groupBy("list", "key", "bucket").count().filter("count > 1").isEmpty()
    assert probes.agg(F.max(F.size("spans"))).first()[0] <= 4  # a day's starts and the interval before
    assert {r["id"]: r["url_filter"]["blocked"] for r in out.collect()} == {
        i: ((timedelta(hours=3 * i, minutes=30) // timedelta(hours=5)) % 2 == 0 and 3 * i < 10_000) for i in range(3000)}
