"""Operator 3: main text of web pages by tag-path ratios.

A page is cut into text blocks, each with the path of block elements (and their class words) from
the root.  Text length, punctuation and link text are summed per path.  The ratios per path (text
per node, punctuation per node, share of text outside links, share of the page's longest path) are
fused into one score, which is 0 for a path that is marked as something else than content (``nav``,
``class="cookie"``, ...).  Scores are smoothed along the page, and paths with a
block above the threshold are selected: their blocks are the main text.

Other blocks come in by their neighbourhood to selected ones.  The region is the smallest element
that holds all selected blocks, or the outermost element around it that is marked as content and
holds no other article.  Its headings, short paragraphs and lists come in, except those in a part of
their own without any selected block (an unmarked sidebar, notice or comment section) and those
marked as something else; in an ``article`` or ``main`` unmarked parts come in too.  A heading that
stands right before the text comes in wherever it stands.  Where an ``article`` or ``main`` holds a
good part of the selected text, selection stays inside of these.  Where the region is the unmarked
page itself, link lists before the first selected block are taken for navigation.

Defined cases: a null or empty page gives an empty text; broken markup is read as far as it goes;
character references are decoded; white space inside a block becomes one space; blocks are joined
by an empty line in page order and nothing is capped.  Repeated rows and ids are read row by row;
an empty table gives no rows.  Only the id, url and page columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var".split())
SKIP_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
OTHER_TAGS = frozenset("head nav header footer aside form dialog menu select button option svg canvas object template video audio "
                       "fieldset".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification popup modal overlay alert sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar "
    "header masthead footer foot bottom copyright legal comment comments reply replies respond disqus discussion share sharing social "
    "related recommended recommendations trending popular teaser paywall donate newsletter subscribe subscription signup login search pagination pager widget widgets tags tagcloud skip "
    "hidden".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CONTENT_WORDS = frozenset("article content main post story entry body text".split())
PARTS = frozenset("p li td tr tbody table ul ol dl dd blockquote pre".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hr main menu nav ol p pre section table ul li dt dd".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：¿¡]")
_HEADING = re.compile("h[1-6]")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    tag: str
    parent: "Node | None"
    path: str
    other: bool           # stands in an element marked as something else than content
    content: bool = False


@dataclass
class Block:
    node: Node
    text: str
    linked: int


def _marks(tag: str, attrs: str, inside: Node) -> tuple[bool, bool, str]:
    """(marked as something else, marked as content, class words for the path)."""
    words: list[str] = []
    other = tag in OTHER_TAGS
    if other and tag == "header" and any(p.tag in ("article", "main") for p in _line(inside)):
        other = False  # the heading of an article
    content = tag in ("article", "main")
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                other |= value.lower() in OTHER_ROLES
                content |= value.lower() in ("main", "article")
            elif name == "style":
                other |= bool(_HIDING.search(value))
            elif name == "hidden":
                other |= value.lower() != "until-found"
            elif name == "aria-hidden":
                other |= value.lower() == "true"
            else:
                found = _WORD.findall(_CAMEL.sub(r"\1 \2", value).lower())
                words += found
                if tag not in ("body", "html", "main", "article") or "comment" in found or "comments" in found:
                    other |= any(x in OTHER_WORDS for x in found) and not ({"content", "article", "post", "body"} & set(found) and not {
                        "comment", "comments", "footer", "header", "sidebar", "nav", "menu", "related", "ad", "ads"} & set(found))
                content |= any(x in CONTENT_WORDS for x in found)
    return other, content and not other, ".".join(dict.fromkeys(words))


def _line(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; raw text elements, comments and markup are left out."""
    top = Node("", None, "", False)
    stack = [top]
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    links = 0
    hidden: list[str] = []  # open inline elements that hide their text
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1], text, linked))
            parts, linked = [], 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def close_to(tags: set[str], stops: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br" or name == "p" and not any(n.tag == "p" for n in stack):
                text(" ")
            elif name in INLINE:
                if name == "a":
                    links = max(0, links - 1)
                if hidden and hidden[-1] == name:
                    hidden.pop()
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        flush()
                        links, hidden = 0, []
                        del stack[i:]
                        break
            continue
        if name in SKIP_RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img", "input"):
                text(" ")
            continue
        if name in INLINE:
            if name == "a":
                links += 1
            if hidden or m[3] and _marks(name, m[3], stack[-1])[0]:
                hidden.append(name)
            continue
        flush()
        links, hidden = 0, []
        if name in CLOSES_P:
            close_to({"p"}, {"table", "td", "th", "button", "object"})
        if name in CLOSES:
            close_to(*CLOSES[name])
        other, content, words = _marks(name, m[3], stack[-1])
        above = stack[-1]
        if m[3].rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        stack.append(Node(name, above, f"{above.path}/{name}" + (f".{words}" if words else ""), above.other or other, content))
    flush()
    return out


def _smooth(values: list[float]) -> list[float]:
    """Gaussian with radius one."""
    side, centre = 0.25, 0.5
    n = len(values)
    return [(centre * values[i] + side * (values[i - 1] if i else values[i]) + side * (values[i + 1] if i + 1 < n else values[i]))
            for i in range(n)]


LEAST_SHARE = 0.35  # of the best score, for a path to be selected


def path_scores(blocks: list[Block]) -> dict[tuple[str, bool], float]:
    """Fused ratios per (path, marked as something else)."""
    paths: dict[tuple[str, bool], list[int]] = {}
    for b in blocks:
        p = paths.setdefault((b.node.path, b.node.other), [0, 0, 0, 0])
        p[0] += 1
        p[1] += len(b.text)
        p[2] += len(_PUNCT.findall(b.text))
        p[3] += min(b.linked, len(b.text))
    longest = max((p[1] for (_, other), p in paths.items() if not other), default=1)
    return {key: math.log1p(chars / n) * math.log1p(1 + marks / n) * (1 - linked / chars) * math.sqrt(min(1.0, chars / longest))
            * (not key[1]) for key, (n, chars, marks, linked) in paths.items()}


def selected_paths(blocks: list[Block]) -> set[tuple[str, bool]]:
    """Paths with a block whose smoothed score reaches the threshold."""
    score = path_scores(blocks)
    key = [(b.node.path, b.node.other) for b in blocks]
    fused = [0.5 * s + 0.5 * score[k] for k, s in zip(key, _smooth([score[k] for k in key]))]
    least = LEAST_SHARE * max(fused)
    return {k for k, s in zip(key, fused) if s >= least and score[k] >= 0.5 * least and score[k] > 0}


def _is_part(node: Node) -> bool:
    return node.tag in PARTS or _HEADING.fullmatch(node.tag) is not None


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the main text, in page order."""
    if not any(not b.node.other for b in blocks):
        return []
    good = selected_paths(blocks)
    own = [b for b in blocks if not b.node.other or (b.node.path, True) in good]
    chosen = [b for b in own if (b.node.path, b.node.other) in good] or [max(own, key=lambda b: len(b.text) - b.linked)]
    marked = [b for b in chosen if any(n.content and n.tag in ("article", "main") for n in _line(b.node))]
    if sum(len(b.text) for b in marked) >= 0.3 * sum(len(b.text) for b in chosen):
        chosen = marked
    shared = {id(n) for n in _line(chosen[0].node)}
    for b in chosen[1:]:
        shared &= {id(n) for n in _line(b.node)}
    root = next(n for n in _line(chosen[0].node) if id(n) in shared)
    while root.parent is not None and _is_part(root):
        root = root.parent
    article = next((n for n in _line(root) if n.tag == "article"), None)
    for n in [n for n in _line(root) if n.content and n.tag not in ("body", "html")]:
        if article is None or not any(_apart(b.node, article, n) for b in own):
            root = n
    picked = {id(b) for b in chosen}
    holds = {id(n) for b in chosen for n in _line(b.node)}  # elements with a selected block
    whole = root.content and root.tag in ("article", "main")

    def near(b: Block) -> bool:
        line = list(_line(b.node))
        if not any(n is root for n in line):
            return False
        parts = line[:next(i for i, n in enumerate(line) if n is root)]
        # a table cell that holds blocks of its own is layout, one that holds text is data
        return whole or all(id(n) in holds or n.content or _is_part(n) and (n is b.node or n.tag not in ("td", "th")) for n in parts)

    first = next(i for i, b in enumerate(own) if id(b) in picked)
    page = not root.content and root.tag in ("body", "html", "")
    keep = [id(b) in picked or near(b) and not (page and i < first and b.linked > 0.6 * len(b.text)) for i, b in enumerate(own)]
    for i in range(len(own) - 2, -1, -1):  # headings right before what is kept
        if keep[i + 1] and not whole and _HEADING.fullmatch(own[i].node.tag) and own[i].linked <= 0.6 * len(own[i].text):
            keep[i] = True
    return [b for b, k in zip(own, keep) if k]


def _apart(node: Node, article: Node, above: Node) -> bool:
    """``node`` stands below ``above`` in another article than ``article``."""
    line = list(_line(node))
    return any(n is above for n in line) and not any(n is article for n in line) and any(
        n.tag == "article" for n in line[:next(i for i, n in enumerate(line) if n is above)])


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in main_blocks(blocks_of(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
