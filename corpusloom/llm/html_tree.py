"""Main-text extraction by a tree-structured graphical model.

The nodes of a page's DOM are hidden binary variables, content or not. A node potential scores what is
seen of the node (tag, words of class and id, text length, link share), a parent-child potential, one for
each tag of the child, how labels go together along an edge. Sum-product messages, upward then downward, give exact marginals; the
text of leaves whose marginal is over a half is the main text. The potentials are learned from labelled
pages by the gradient of the exact likelihood, which the same messages give.

Pages of a batch form one forest and messages pass level by level as array operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm._store import small_batches
from corpusloom.llm._text import ddl, renamed, slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")

RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends open elements of these names, up to the nearest of the limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

TAGS = {t: i for i, t in enumerate("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset button menu details summary dialog address #text #other".split())}
WORDS = {w: i for i, w in enumerate("ad ads advert advertisement sponsor sponsored promo banner nav navigation menu breadcrumb breadcrumbs pagination footer header masthead sidebar side aside widget related recommended popular comment comments reply respond discussion disqus cookie cookies consent notice alert warning popup modal overlay newsletter subscribe signup login search form share social follow tags meta copyright legal hidden article content entry post story main body text page".split())}


def _feature_names() -> list[str]:
    names = ["bias", *(f"tag:{t}" for t in TAGS), *(f"parent:{t}" for t in TAGS), *(f"word:{w}" for w in WORDS)]
    return names + [f"chars:{i}" for i in range(6)] + [f"links:{i}" for i in range(3)] + ["hidden"] + [f"{a} in {b}" for b in TAGS for a in TAGS]


FEATURES = {n: i for i, n in enumerate(_feature_names())}
BIAS, TAG0, PARENT0, WORD0 = 0, 1, 1 + len(TAGS), 1 + 2 * len(TAGS)
CHARS0 = WORD0 + len(WORDS)
LINKS0, HIDDEN = CHARS0 + 6, CHARS0 + 9
PAIR0 = HIDDEN + 1
TEXT, OTHER = TAGS["#text"], TAGS["#other"]


@dataclass
class Tree:
    """Nodes in page order; ``text`` of leaves, else None. parent[0] is -1."""

    tag: list[int]
    parent: list[int]
    features: list[list[int]]
    text: list[str | None]
    mark: list[bool]


@lru_cache(maxsize=4096)
def _attribute_features(attributes: str) -> tuple[tuple[int, ...], bool]:
    out, marked = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            out.append(HIDDEN)
        for part in PART.findall(value):
            w = WORDS.get(part.lower())
            if w is not None:
                out.append(WORD0 + w)
    if "data-main" in attributes:
        marked = True
    return tuple(dict.fromkeys(out)), marked


def parse(page: str | None) -> Tree:
    """Block elements and runs of text between them; a missing body is put in. Inline tags are no nodes; line breaks are white space."""
    t = Tree([TAGS["html"]], [-1], [[BIAS, TAG0 + TAGS["html"]]], [None], [False])
    if not page:
        return t
    stack = [("#root", 0)]
    parts: list[str] = []
    linked = in_link = 0

    def node(name, tag, words=(), marked=False):
        up = stack[-1][1]
        t.tag.append(tag)
        t.parent.append(up)
        t.features.append([BIAS, TAG0 + tag, PARENT0 + t.tag[up], PAIR0 + len(TAGS) * t.tag[up] + tag, *words])
        t.text.append(None)
        t.mark.append(t.mark[up] or marked)
        stack.append((name, len(t.tag) - 1))

    def leaf():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                if len(stack) == 1:
                    node("body", TAGS["body"])
                up = stack[-1][1]
                n = len(text)
                share = min(1.0, linked / max(n, 1))
                t.tag.append(TEXT)
                t.parent.append(up)
                t.features.append([BIAS, TAG0 + TEXT, PARENT0 + t.tag[up], PAIR0 + len(TAGS) * t.tag[up] + TEXT, CHARS0 + min(5, n.bit_length() // 2 - 1 if n > 7 else 0), LINKS0 + (0 if share < 0.1 else 1 if share < 0.5 else 2)])
                t.text.append(text)
                t.mark.append(t.mark[up])
        linked = 0

    def pop(names, limits):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in limits:
                return
            if stack[k][0] in names:
                leaf()
                del stack[k:]
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        m = TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if lt >= n:
            break
        if m is None:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = 0
            elif name == "br":
                parts.append(" ")
            elif name not in INLINE:
                if any(x[0] == name for x in stack[1:]):
                    leaf()
                    while stack.pop()[0] != name:
                        pass
                elif name == "p":
                    leaf()
            continue
        if name in RAW:
            leaf() if name not in ("svg", "math", "select") else parts.append(" ")
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                at = n
            else:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 1
            continue
        leaf()
        if name in ENDS_P:
            pop({"p"}, {"table", "div", "section", "article", "aside", "nav", "form", "td", "li", "blockquote"})
        if name in CLOSES:
            pop(*CLOSES[name])
        if name in VOID:
            continue
        if name == "html":
            continue
        if len(stack) == 1 and name not in ("head", "body"):
            node("body", TAGS["body"])
        words, marked = _attribute_features(m[3])
        node(name, TAGS.get(name, OTHER), words, marked)
    leaf()
    return t


@dataclass
class Potentials:
    node: np.ndarray  # score of "content" by feature
    edge: np.ndarray  # tag of the child x 2 x 2, parent label by child label


class ForestBatch:
    """Many trees as arrays, with levels for message passing."""

    def __init__(self, trees: list[Tree]):
        base = np.cumsum([0] + [len(t.tag) for t in trees])
        self.base = base
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + b) for t, b in zip(trees, base)])
        self.tag = np.concatenate([np.array(t.tag) for t in trees])
        flat = [f for t in trees for f in t.features]
        sizes = np.array([len(f) for f in flat])
        self.features = np.concatenate([np.array(f) for f in flat])
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def scores(self, w: Potentials) -> np.ndarray:
        u = np.zeros((len(self.parent), 2))
        u[:, 1] = np.bincount(self.owner, w.node[self.features], minlength=len(u))
        return u

    def sum_product(self, w: Potentials) -> tuple[np.ndarray, np.ndarray, float]:
        """(marginal of content by node, joint parent-child marginals 2 x 2 by node, log partition)."""
        u = self.scores(w)
        up = np.zeros_like(u)
        inside = u.copy()
        for level in self.levels[:0:-1]:
            x = inside[level][:, None, :] + w.edge[self.tag[level]]
            up[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            np.add.at(inside, self.parent[level], up[level])
        roots = self.levels[0]
        log_z = float(np.logaddexp(inside[roots, 0], inside[roots, 1]).sum())
        down = np.zeros_like(u)
        joint = np.zeros((len(u), 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = inside[p] + down[p] - up[level]
            x = rest[:, :, None] + w.edge[self.tag[level]] + inside[level][:, None, :]
            top = x.max((1, 2), keepdims=True)
            e = np.exp(x - top)
            joint[level] = e / e.sum((1, 2), keepdims=True)
            y = rest[:, :, None] + w.edge[self.tag[level]]
            down[level] = np.logaddexp(y[:, 0], y[:, 1])
        belief = inside + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint, log_z


def train(trees: list[Tree], rounds: int = 200, rate: float = 0.15, decay: float = 5e-5) -> Potentials:
    """Gradient ascent (with adaptive steps) on the exact log-likelihood of the labels, mean by node."""
    f = ForestBatch(trees)
    y = np.array([m for t in trees for m in t.mark], int)
    n, k = len(y), len(FEATURES)
    child = np.flatnonzero(f.parent >= 0)
    seen_node = np.bincount(f.features, y[f.owner], minlength=k)
    shape = (len(TAGS), 2, 2)
    seen_edge = np.zeros(shape)
    np.add.at(seen_edge, (f.tag[child], y[f.parent[child]], y[child]), 1)
    w = Potentials(np.zeros(k), np.zeros(shape))
    m = [np.zeros(k), np.zeros(shape)]
    v = [np.zeros(k), np.zeros(shape)]
    for step in range(1, rounds + 1):
        p, joint, _ = f.sum_product(w)
        g = [(seen_node - np.bincount(f.features, p[f.owner], minlength=k)) / n - decay * w.node, (seen_edge - _by_tag(f.tag[child], joint[child])) / n - decay * w.edge]
        for i, x in enumerate((w.node, w.edge)):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            x += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return w


def _by_tag(tag: np.ndarray, joint: np.ndarray) -> np.ndarray:
    out = np.zeros((len(TAGS), 2, 2))
    np.add.at(out, tag, joint)
    return out


def labelled_pages(count: int = 400, seed: int = 3) -> list[str]:
    """Pages of many layouts, made up by rule, whose content elements carry a data-main mark."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    made = np.array(["".join(pick("ka", "to", "ri", "mel", "un", "sha", "po", "ent") for _ in range(k % 3 + 1)) for k in range(300)])
    words = lambda a, b: " ".join(made[rng.integers(0, len(made), rng.integers(a, b))])
    link = lambda: f'<a href="/{words(1, 2)}">{words(1, 4)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 8))) + "</ul>"
    para = lambda: pick(f"<p>{words(1, 90)}.</p>", f"<p>{words(1, 4)}.</p>", f"<p>{words(9, 20) * 20}.</p>", f"<p>{words(2, 3) * 30}</p>", f"<p>{words(1, 4)}.</p>" * 20, f"<p>{words(8, 60)} {link()} {words(4, 30)}.</p>", f"<p><b>{words(2, 9)}.<br><p>{words(20, 90)}.</p>", f"<p>{words(2, 120)}.")
    block = lambda: pick(para(), para(), para(), para(), f"<h2>{words(1, 7)}</h2>", f"<ul><li>{words(2, 20)}</li><li>{words(2, 20)}</li></ul>", f"<ol><li>{words(2, 20)}<li>{words(2, 20)}</ol>", f"<blockquote><p>{words(8, 40)}</p></blockquote>", f"<pre>{words(4, 20)}</pre>", f"<table><tr><th>{words(1, 3)}</th><td>{words(1, 8)}</td></tr></table>", f"<figure><img src=x><figcaption>{words(3, 12)}</figcaption></figure>", f"<div>{words(10, 60)}</div>", f"<section><h3>{words(1, 6)}</h3><p>{words(10, 60)}</p></section>")

    def boiler() -> str:
        return pick(
            lambda: f"<nav>{links()}</nav>",
            lambda: f'<div class="{pick("ad", "ads", "advert", "ad-box", "sponsored", "promo banner")}">{pick(words(2, 30), "<p>" + words(5, 40) + "</p>")}</div>',
            lambda: f'<aside class="{pick("sidebar", "widget", "related", "")}"><h3>{words(1, 4)}</h3>{pick(links(), "<p>" + words(8, 50) + "</p>")}</aside>',
            lambda: f'<div class="{pick("sidebar", "side-bar", "widget", "related-posts", "recommended", "popular")}">{pick(links(), "<p>" + words(8, 50) + "</p>")}</div>',
            lambda: f'<div {pick("class", "id")}="{pick("cookie-notice", "cookie-banner", "notice", "consent", "alert", "newsletter", "popup", "site-notice")}"><p>{words(5, 40)}</p>{pick("", "<button>" + words(1, 3) + "</button>")}</div>',
            lambda: f'<form action="/x"><label>{words(1, 4)}</label><input name=q><p>{words(3, 30)}</p><button>{words(1, 3)}</button></form>',
            lambda: f'<{pick("section", "div")} {pick("class", "id")}="{pick("comments", "comment-list", "respond", "discussion")}"><h3>{words(1, 4)}</h3>' + "".join(pick(f'<div class="comment"><p>{words(4, 60)}</p></div>', f"<article><p>{words(4, 60)}</p></article>", f"<p>{words(4, 60)}</p>") for _ in range(rng.integers(1, 5))) + "</" + "section></div>",
            lambda: f'<div class="{pick("menu", "navigation", "breadcrumb", "pagination", "social share", "tags", "meta")}">{pick(links(), link() + " " + link(), words(2, 9))}</div>',
        )()

    def page() -> str:
        title = words(2, 10)
        inner = f"<h1>{title}</h1>" * int(rng.random() < 0.8) + "".join(block() for _ in range(pick(1, 1, 2, 3, 5, 8, 12, 30)))
        within = rng.random() < 0.3
        if within:
            cut = inner.rfind("<p>")
            if cut > 0:
                inner = inner[:cut] + boiler().replace("<p>", '<p data-not="">') + inner[cut:]
        body = pick("article", "article", "article", "article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'div class="entry-content"', "section", "div")
        shut = body.split()[0]
        core = f'<{body} data-main="">{inner}</{shut}>'
        if rng.random() < 0.3:
            core = f"<main>{core}{boiler() if rng.random() < 0.5 else ''}</main>"
        top = pick("", f"<header><p>{words(1, 9)}</p>{pick('', links())}</header>", f'<div class="header">{words(1, 6)}</div>', f"<header><h1>{words(1, 4)}</h1></header>")
        foot = pick("", f"<footer>&copy; {words(2, 20)}</footer>", f"<footer><p>{words(2, 20)}</p>{links()}</footer>", f'<div id="footer">{words(2, 20)} {link()}</div>')
        before, after = "".join(boiler() for _ in range(pick(0, 0, 1, 2, 3))), "".join(boiler() for _ in range(pick(0, 0, 1, 2, 3)))
        end = pick("</body></html>", "")
        if rng.random() < 0.2:
            top = before = after = foot = ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{top}{before}{core}{after}{foot}{end}"

    return [page() for _ in range(count)]


def unmark(t: Tree) -> Tree:
    """Takes the mark off boilerplate elements that sit inside content, and all below them."""
    off = [False] * len(t.tag)
    bad = {TAGS[x] for x in ("nav", "aside", "form", "button", "footer", "header")}
    good = {WORDS[x] for x in ("article", "content", "entry", "post", "story", "main", "body", "text", "page")}
    for i in range(1, len(t.tag)):
        words = {f - WORD0 for f in t.features[i] if WORD0 <= f < CHARS0}
        off[i] = off[t.parent[i]] or t.tag[i] in bad or bool(words - good)
        t.mark[i] = t.mark[i] and not off[i]
    return t


@lru_cache(maxsize=1)
def default_potentials() -> Potentials:
    return train([unmark(parse(p)) for p in labelled_pages()])


def texts(pages: list[str | None], w: Potentials) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    f = ForestBatch(trees)
    p, _, _ = f.sum_product(w)
    out = []
    for t, lo in zip(trees, f.base):
        out.append("\n\n".join(x for i, x in enumerate(t.text) if x is not None and p[lo + i] > 0.5))
    return out


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", potentials: Potentials | None = None) -> DataFrame:
    """pages with the main text as one column more: blocks in page order, joined by an empty line. No column may have its name
    already (ValueError); ``out`` takes another.

    Null and empty pages, and pages without content, give the empty text. A leaf is the text between two
    block tags with references decoded and white space collapsed.
    """
    spark: SparkSession = pages.sparkSession
    small_batches(spark)
    if out.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"pages already has a column named {out}")
    src, back = renamed(pages)
    at = back.index(html_col)
    shared = spark.sparkContext.broadcast(potentials or default_potentials())

    def work(batches):
        w = shared.value
        for b in batches:
            for s, e in slices(b.column(at)):
                got = texts(b.column(at).slice(s, e - s).to_pylist(), w)
                yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in b.columns] + [pa.array(got, pa.string())], [*b.schema.names, "_x"])

    return src.mapInArrow(work, ddl(src) + ", _x string").toDF(*back, out)
