"""Main-text extraction with a tree-structured graphical model over DOM nodes.

Every block-level element is a node that is content or not. A node's own features (tag, class names, amount of text, links)
give its evidence; a child depends on its parent through potentials by kind of child. One pass of messages up the tree and one
down give exact marginals. All tables are counted from labelled pages, which labelled_pages() writes from layouts.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import in_arrow

#: Labelled pages that the model is trained on, and the seed that they are written with.
TRAINING_PAGES, SEED = 600, 11
#: Marginal from which a node's own text is content.
CONTENT = 0.5

#: Elements that are left out with all that is in them: no prose, form controls, graphics, and other documents. What math, object,
#: noscript and canvas hold is text like any other.
_RAW = {"script", "style", "template", "title", "textarea", "iframe", "svg", "select", "button", "head"}
_CLOSE = {tag: re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|<body\b", re.I) for tag in _RAW}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _HEADINGS | {
    "html", "body", "p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "caption", "pre", "blockquote", "figure", "figcaption", "address", "fieldset", "details", "summary", "dialog", "menu", "center", "label",
}
#: Start tags that end an open paragraph, list item or cell.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_SCOPES = {"ul", "ol", "dl", "table", "body", "html", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote", "menu"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Kinds of tags; a child's dependence on its parent is learnt for each.
_KINDS = {
    **dict.fromkeys(["article", "main"], "article"), **dict.fromkeys(_HEADINGS, "heading"), **dict.fromkeys(["nav", "menu"], "nav"), "header": "header", "footer": "footer", "aside": "aside",
    **dict.fromkeys(["form", "fieldset", "label", "dialog"], "form"), **dict.fromkeys(["p", "pre", "blockquote", "figcaption", "summary"], "text"), **dict.fromkeys(["ul", "ol", "dl"], "list"),
    **dict.fromkeys(["li", "dt", "dd"], "item"), **dict.fromkeys(["table", "thead", "tbody", "tfoot", "tr"], "table"), **dict.fromkeys(["td", "th", "caption"], "cell"), "address": "footer", "html": "root", "body": "root",
}
_KIND_NAMES = ["other", *sorted(set(_KINDS.values()))]
#: Words in class, id and role names, by what they speak for.
_NAME_GROUPS = [
    re.compile(r"comment|disqus|repl(y|ies)|respond|discussion"),
    re.compile(r"\bads?\b|ad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|notice|cookie|consent|alert|popup|modal|newsletter|subscri|signup|login|paywall"),
    re.compile(r"nav|menu|breadcrumb|sidebar|side[-_]|widget|footer|header|masthead|topbar|toolbar|pager|pagination|share|social|related|recommend|tag|meta|byline|search|copyright|legal|skip"),
    re.compile(r"article|content|post|story|entry|main|body|text|prose"),
]


@dataclass
class Node:
    tag: str
    parent: int
    names: int
    #: Runs of the node's own text in page order: (place, pieces).
    runs: list[tuple[int, list[str]]] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    label: int | None = None


def parse(page: str) -> list[Node]:
    """The block-level elements in page order, each with its own text (inline elements' text included). Elements that hold no
    prose, such as scripts, are left out with all that is in them; missing and stray end tags are mended as browsers do."""
    nodes = [Node("html", -1, 0)]
    stack = [0]
    opened: Counter[str] = Counter()  # of the tags on the stack, so none is looked for that isn't there
    unclosed: set[str] = set()  # raw elements that no end tag follows any more
    last = page.rfind(">") + 1
    pos = place = link = 0

    def text(raw: str) -> None:
        nonlocal place
        if not raw:
            return
        node = nodes[stack[-1]]
        piece = html_lib.unescape(raw)
        if not node.runs or node.runs[-1][0] != place:
            if piece.isspace():
                return
            place += 1
            node.runs.append((place, []))
        node.runs[-1][1].append(piece)
        size = len(piece.strip())
        node.chars += size
        node.link_chars += size if link else 0

    def leave(k: int) -> None:
        opened.subtract(nodes[i].tag for i in stack[k:])
        del stack[k:]

    while m := _TAG.search(page, pos, last):
        text(page[pos : m.start()])
        pos = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not end and not attrs.rstrip().endswith("/"):
                close = None if tag in unclosed else _CLOSE[tag].search(page, pos)
                if close:
                    pos = close.start() if close[0][1] != "/" else close.end()
                elif tag != "head":
                    pos = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag in _VOID:
            if tag in ("br", "hr", "wbr"):
                text(" " if tag != "wbr" else "")
            continue
        if tag not in _BLOCKS:
            if tag == "a":
                link = 0 if end else 1
            continue
        link = 0
        if end:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if nodes[stack[k]].tag == tag:
                    leave(k)
                    break
            place += 1
            continue
        if tag == "html":
            continue
        ends = _ENDS.get(tag, {"p"} | _HEADINGS if tag in _HEADINGS else {"p"})
        for k in range(len(stack) - 1, 0, -1) if any(opened[name] for name in ends) else ():
            name = nodes[stack[k]].tag
            if name in ends:
                leave(k)
                if tag not in _ENDS:
                    break
            elif name in _SCOPES and name not in ends and not (tag == "li" and name not in ("ul", "ol", "menu", "body")):
                break
        found = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower()
        names = next((k for k, g in enumerate(_NAME_GROUPS, 1) if found and g.search(found)), 0)
        place += 1
        nodes.append(Node(tag, stack[-1], names))
        if m := re.search(r'data-label="([01])"', attrs):
            nodes[-1].label = int(m[1])
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    text(page[pos:])
    return nodes


def _evidence(nodes: list[Node]) -> list[tuple[int, int, int, int, int, int]]:
    """Features of each node: kind, names (and whether the body itself is the parent), own text, own links, and the text and
    links below it."""
    chars, links = [n.chars for n in nodes], [n.link_chars for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    size = lambda c: 0 if not c else 1 if c < 30 else 2 if c < 90 else 3 if c < 300 else 4
    share = lambda a, c: 0 if not c else 1 if a * 4 <= c else 2 if a * 4 <= 3 * c else 3
    under_body = lambda n: n.parent < 0 or nodes[n.parent].tag in ("html", "body")
    return [(_KIND_NAMES.index(_KINDS.get(n.tag, "other")), n.names + (1 + len(_NAME_GROUPS)) * under_body(n), size(n.chars), share(n.link_chars, n.chars), size(chars[i]), share(links[i], chars[i])) for i, n in enumerate(nodes)]


_SIZES = (len(_KIND_NAMES), 2 * (1 + len(_NAME_GROUPS)), 5, 4, 5, 4)


@dataclass
class TreeModel:
    """Log tables: root state; child's state by (kind, names, parent's state); each further feature by (kind, state)."""

    root: list[float]
    edge: list
    own: list


def train(pages: list[str]) -> TreeModel:
    """Counts the potentials on pages whose elements carry data-label; an element without one has its parent's label."""
    root = np.ones(2)
    edge = np.full((_SIZES[0], _SIZES[1], 2, 2), 0.5)
    own = [np.full((_SIZES[0], 2, n), 2.0) for n in _SIZES[2:]]
    seen_as = np.zeros((_SIZES[0], 2))
    for page in pages:
        nodes = parse(page)
        for node, seen in zip(nodes, _evidence(nodes)):
            node.label = (nodes[node.parent].label if node.parent >= 0 else 0) if node.label is None else node.label
            seen_as[seen[0], node.label] += 1
            if node.parent < 0:
                root[node.label] += 1
            else:
                edge[seen[0], seen[1], nodes[node.parent].label, node.label] += 1
                for table, value in zip(own, seen[2:]):
                    table[seen[0], node.label, value] += 1
    for kind, state in zip(*np.nonzero(seen_as == 0)):  # a kind that was never in a state gives no evidence about it
        for table in own:
            table[kind, state] = table[kind, 1 - state]
    log = lambda t: np.log(t / t.sum(axis=-1, keepdims=True)).tolist()
    return TreeModel(log(root), log(edge), [log(t) for t in own])


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    hi, lo = (a, b) if a > b else (b, a)
    return hi + float(np.log1p(np.exp(lo - hi))) if hi - lo < 40 else hi


def marginals(model: TreeModel, nodes: list[Node]) -> list[float]:
    """The probability that each node is content, by sum-product messages from the leaves to the root and back."""
    seen = _evidence(nodes)
    belief = []
    for f in seen:
        e = [0.0, 0.0]
        for table, value in zip(model.own, f[2:]):
            row = table[f[0]]
            e[0] += row[0][value]
            e[1] += row[1][value]
        belief.append(e)
    up: list = [None] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        t, b = model.edge[seen[i][0]][seen[i][1]], belief[i]
        up[i] = (_add(t[0][0] + b[0], t[0][1] + b[1]), _add(t[1][0] + b[0], t[1][1] + b[1]))
        above = belief[nodes[i].parent]
        above[0] += up[i][0]
        above[1] += up[i][1]
    down = [(model.root[0], model.root[1])] + [None] * (len(nodes) - 1)
    out = []
    for i, node in enumerate(nodes):
        if i:
            p, t = node.parent, model.edge[seen[i][0]][seen[i][1]]
            a0, a1 = (down[p][s] + belief[p][s] - up[i][s] for s in (0, 1))
            hi = max(a0, a1)
            a0, a1 = a0 - hi, a1 - hi
            down[i] = (_add(t[0][0] + a0, t[1][0] + a1), _add(t[0][1] + a0, t[1][1] + a1))
        gap = down[i][0] + belief[i][0] - down[i][1] - belief[i][1]
        out.append(1 / (1 + float(np.exp(min(gap, 700)))))
    return out


def extract(model: TreeModel, page: str | None) -> str:
    """The main text: content blocks in page order, white space inside each turned into one space, joined by blank lines."""
    if not page:
        return ""
    nodes = parse(page)
    runs = [run for node, p in zip(nodes, marginals(model, nodes)) if p >= CONTENT for run in node.runs]
    blocks = (" ".join("".join(pieces).split()) for _, pieces in sorted(runs, key=lambda r: r[0]))
    return "\n\n".join(b for b in blocks if b)


# -- labelled pages ---------------------------------------------------------------------------------------------------
def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Pages of many layouts with data-label on elements: 1 where the article starts, 0 where something else does."""
    rng = random.Random(seed)
    pick = rng.choice
    syllables = ["ka", "lo", "mir", "ten", "su", "val", "or", "qui", "da", "nes", "ti", "ber"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{some(a, b)}</a>'
    prose = lambda: some(*pick([(1, 6), (6, 15), (8, 30), (30, 90), (60, 200)])) + pick([".", ".", ".", "", "!"])
    named = lambda *names: pick(["class", "class", "id"]) + f'="{pick(names)}"'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"

    def paragraph() -> str:
        inside = prose()
        if rng.random() < 0.2:
            inside += f" {link()} {some(3, 20)}."
        if rng.random() < 0.2:
            inside = f"<b>{inside}" + pick(["</b>", "<br>", ""])
        return pick(["<p>{}</p>"] * 6 + ["<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>", "<pre>{}</pre>"]).format(inside)

    def article() -> str:
        parts = [f"<h{pick('112')}>{some(3, 10)}</h1>".replace("</h1>", "</h1>")] if rng.random() < 0.85 else []
        for _ in range(pick([1, 1, 2, 2, 3, 5, 8])):
            r = rng.random()
            if r < 0.8:
                parts.append(paragraph())
            elif r < 0.86:
                parts.append(f"<h2>{some(1, 6)}</h2>")
            elif r < 0.93:
                tag = pick(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{some(3, 25)}.</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif r < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{some(1, 3)}</td><td>{some(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(pick([advert, notice, sharing])())
        return "".join(parts)

    advert = lambda: f'<{(t := pick(["div", "div", "aside", "section", "p"]))} data-label="0" {named("ad", "ads", "advert", "sponsored", "promo-box", "banner", "ad-slot")}>{pick([some(2, 30) + ".", link(2, 6), f"<p>{some(4, 25)}.</p>"])}</{t}>'
    notice = lambda: f'<{(t := pick(["div", "section", "aside", "p"]))} data-label="0" {named("notice", "cookie-notice", "consent", "alert", "newsletter", "subscribe", "paywall")}>{pick([some(4, 40) + ".", f"<p>{some(5, 40)}.</p>{link()}"])}</{t}>'
    sharing = lambda: f'<div data-label="0" {named("share", "social", "tags", "related", "breadcrumb", "pagination", "byline")}>{pick([menu(), link(), some(1, 5)])}</div>'
    nav = lambda: pick([f'<nav data-label="0">{pick([menu(), link() + link() + link()])}</nav>', f'<div data-label="0" {named("nav", "menu", "topbar", "navigation")}>{menu()}</div>', f'<ul data-label="0" {named("menu", "nav-list")}>' + menu()[4:]])
    header = lambda: pick([f'<header data-label="0"><h1>{some(1, 4)}</h1>{pick([nav(), link(), some(2, 8)])}</header>', f'<div data-label="0" {named("header", "masthead", "site-header")}><h2>{some(1, 3)}</h2><p>{some(2, 8)}</p></div>'])
    footer = lambda: pick([f'<footer data-label="0">&copy; {word()} &middot; {some(2, 25)}.</footer>', f'<footer data-label="0"><p>{some(2, 20)}.</p>{menu()}</footer>', f'<div data-label="0" {named("footer", "site-footer", "copyright", "legal")}>&copy; {some(2, 25)} {link()}</div>'])
    aside = lambda: pick([f'<aside data-label="0"><h3>{some(1, 4)}</h3>{pick([menu(), f"<p>{some(5, 40)}.</p>"])}</aside>', f'<div data-label="0" {named("sidebar", "widget", "related", "recommended", "side-column")}><h3>{some(1, 4)}</h3>{pick([menu(), f"<p>{prose()}</p>"])}</div>'])
    form = lambda: f'<form data-label="0" action="/x"><label>{some(1, 3)}</label><input name="q"><p>{some(2, 15)}</p></form>'

    def comments() -> str:
        tag = pick(["div", "section", "ol"])
        item = pick(["div", "li", "article", "p"])
        inside = "".join(f'<{item} class="{pick(["comment", "reply", "comment-body"])}">{pick([prose(), f"<p>{prose()}</p>", f"<h4>{word()}</h4><p>{prose()}</p>"])}</{item}>' for _ in range(rng.randint(1, 6)))
        return f'<{tag} data-label="0" {named("comments", "comment-list", "replies", "discussion", "disqus_thread")}><h3>{some(1, 3)}</h3>{inside}</{tag}>'

    def page() -> str:
        before = [f() for f in (header, nav, advert, notice, sharing, form) if rng.random() < 0.45]
        after = [f() for f in (comments, aside, advert, notice, form, sharing, footer, footer) if rng.random() < 0.45]
        for part in (before, after):
            rng.shuffle(part)
        if rng.random() < 0.08:
            core = "".join(f'<p data-label="1">{prose()}</p>' for _ in range(rng.randint(2, 8)))
        else:
            tag, names = pick([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-body"), ("div", "article-text"), ("div", "story"), ("section", "entry-content"), ("div", "main-text"), ("div", "")])
            core = f'<{tag} data-label="1"' + (f' {named(names)}' if names else "") + f">{article()}" + ("".join(pick([comments, sharing, advert, aside])() for _ in range(1)) if rng.random() < 0.25 else "") + f"</{tag}>"
        inside = "".join(before) + core + "".join(after)
        if rng.random() < 0.3:
            inside = f'<div class="{pick(["wrapper", "page", "container", "row"])}" data-label="0">{inside}</div>'
        return f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title></head><body>{inside}</body></html>"

    return [page() for _ in range(n)]


def with_main_text(pages: DataFrame, model: TreeModel, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col, the main text of the whole html; null, empty and contentless pages have an empty one. A column that is
    named out_col already is replaced; all rows stay."""
    pages = pages.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(model, h.as_py()) for h in batch.column(batch.schema.names.index(html_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, out_col])

    return in_arrow(pages, run, T.StructType([*pages.schema.fields, T.StructField(out_col, T.StringType(), False)]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length in code points; null html has an empty text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return with_main_text(pages, train(labelled_pages())).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
