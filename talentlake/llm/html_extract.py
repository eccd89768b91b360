"""Main text of web pages by a tree-structured graphical model.

Block elements and text blocks of a page form a tree. Every node is content or not; its own evidence comes from tag,
words of class, id and role, and the shape of its text, and potentials tie it to its parent. Sum-product messages pass
once up and once down the tree and give each text block its content marginal. Evidence and potentials are learned from
labelled pages by maximum likelihood, with the same messages giving the expected counts.

Defined results: a null or empty html, or a page without content, gives an empty text; unclosed, stray and unknown tags
are tolerated as browsers do; a comment or script that never ends takes the rest of the page; character references are
decoded once; line breaks inside a block count as white space; repeated rows are treated alike; a null url stays null.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:\s|/|\A)(class|id|role|hidden|data-main)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile("[a-z]+")
# Elements whose text is never page text.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "select", "canvas", "noframes"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter q ruby rb rt rp s samp small span strike "
    "strong sub sup time tt u var wbr br button link meta base area audio video source track embed param picture output progress map object "
    # Formulas and drawings stand inside a line.
    "math semantics annotation mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mfenced menclose mstyle mpadded "
    "mphantom svg g text tspan textpath path circle ellipse rect line polyline polygon use defs symbol marker lineargradient radialgradient stop clippath mask pattern desc".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SEPARATES = {"br", "img", "input", "button", "td", "th", "text", "tspan", "mtr", "mtd"}
# A start tag of the key closes an open element of the set, up to the bound.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, set())}


class Tree:
    """Nodes in page order, parents first: block elements and text blocks (leaves)."""

    def __init__(self, html: str):
        self.parent, self.leaf, self.features, self.texts, self.kept = [-1], [False], [["tag=root"]], [None], [False]
        stack: list[tuple[str, int]] = [("root", 0)]
        run: list[str] = []
        linked = links = 0  # characters inside links, and open links
        at, size = 0, len(html)

        def close_run():
            nonlocal linked, links
            if run:
                text = " ".join(unescape("".join(run)).split())
                run.clear()
                if text:
                    name, node = stack[-1]
                    self.parent.append(node)
                    self.leaf.append(True)
                    self.features.append(leaf_features(text, linked, name))
                    self.texts.append(text)
                    self.kept.append(self.kept[node])
            linked = 0

        while at < size:
            found = TOKEN.search(html, at)
            stop = found.start() if found else size
            if stop > at:
                run.append(html[at:stop])
                if links:
                    linked += stop - at
            if not found:
                break
            at = found.end()
            if found[2] is None:
                continue
            name = found[2].lower()
            if found[1]:
                if name in INLINE:
                    links = max(0, links - 1) if name == "a" else links
                    continue
                close_run()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        links = 0
                        break
                continue
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(html, at)
                at = (html.find(">", end.start()) + 1 or size) if end else size
                continue
            if name == "xmp":  # its markup is text
                close_run()
                end = re.compile("</xmp[\\s/>]", re.I).search(html, at)
                run.append(escape(html[at : end.start() if end else size]))
                at = (html.find(">", end.start()) + 1 or size) if end else size
                close_run()
                continue
            if name in INLINE:
                links += name == "a"
                if name in SEPARATES:
                    run.append(" ")
                continue
            close_run()
            links = 0
            if name in IMPLIED:
                closes, bound = IMPLIED[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in bound:
                        break
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
            if stack[-1][0] == "p" or any(n == "p" for n, _ in stack[-3:]):  # a block ends an open paragraph
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
            if name in VOID:
                continue
            node = len(self.parent)
            names, kept = attribute_features(found[3])
            self.parent.append(stack[-1][1])
            self.leaf.append(False)
            self.features.append([f"tag={name}", f"tag={name}<{stack[-1][0]}", *names])
            self.texts.append(None)
            self.kept.append(self.kept[stack[-1][1]] if kept is None else kept)
            stack.append((name, node))
        close_run()


def attribute_features(source: str) -> tuple[list[str], bool | None]:
    """Words of class, id and role, and the label of a labelled page (data-main)."""
    if "=" not in source and "hidden" not in source:
        return [], None
    words, kept = set(), None
    for name, a, b, c in NAMES.findall(source):
        name, value = name.lower(), (a or b or c).lower()
        if name == "data-main":
            kept = value == "1"
        elif name == "hidden":
            words.add("hidden")
        else:
            words.update(WORD.findall(value))
    return [f"name={w}" for w in sorted(words)], kept


def leaf_features(text: str, linked: int, parent: str) -> list[str]:
    size = len(text)
    share = min(linked / size, 1.0)
    return [
        f"in={parent}", f"size={min(size.bit_length(), 10)}", f"links={0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"end={text[-1] in '.!?:…”\"'}", f"commas={text.count(',') > 1}", "sign=©" if "©" in text else "sign=none"]


@dataclass
class Model:
    """Log evidence for content of each feature, and potentials [leaf][parent state][own state]."""

    index: dict[str, int]
    weights: np.ndarray
    ties: np.ndarray


@dataclass
class Forest:
    """Nodes of several pages, with the levels of their trees."""

    parent: np.ndarray
    leaf: np.ndarray
    owner: np.ndarray
    feature: np.ndarray
    levels: list[np.ndarray]


def forest_of(trees: list[Tree], index: dict[str, int]) -> Forest:
    parent, leaf, owner, feature, depth, base = [], [], [], [], [], 0
    for t in trees:
        own = [0] * len(t.parent)
        for i in range(1, len(own)):
            own[i] = own[t.parent[i]] + 1
        depth += own
        parent += [p + base if p >= 0 else -1 for p in t.parent]
        leaf += t.leaf
        for i, names in enumerate(t.features, base):
            for k in map(index.get, names):
                if k is not None:
                    owner.append(i)
                    feature.append(k)
        base += len(own)
    depth = np.array(depth, np.int64)
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2)) if len(depth) else []
    return Forest(np.array(parent, np.int64), np.array(leaf, np.int64), np.array(owner, np.int64), np.array(feature, np.int64), np.split(order, edges)[1:])


def messages(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (node, state), and of each node jointly with its parent (node, parent state, own state)."""
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(forest.owner, model.weights[forest.feature], n)
    up, down, sent = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    for level in reversed(forest.levels):
        if len(level):
            sent[level] = np.logaddexp.reduce(model.ties[forest.leaf[level]] + (own + up)[level][:, None, :], axis=2)
            for s in (0, 1):
                up[:, s] += np.bincount(forest.parent[level], sent[level, s], n)
    joint = np.full((n, 2, 2), -np.inf)
    for level in forest.levels:
        if len(level):
            above = forest.parent[level]
            rest = (own + up + down)[above] - sent[level]
            both = model.ties[forest.leaf[level]] + rest[:, :, None]
            down[level] = np.logaddexp.reduce(both, axis=1)
            joint[level] = both + (own + up)[level][:, None, :]
    belief = own + up + down
    belief = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])
    inner = forest.parent >= 0
    pairs = np.zeros((n, 2, 2))
    pairs[inner] = np.exp(joint[inner] - np.logaddexp.reduce(joint[inner].reshape(-1, 4), axis=1)[:, None, None])
    return belief, pairs


def train(pages: list[str], rounds: int = 200, shrink: float = 0.0005) -> Model:
    """Maximum likelihood on labelled pages: elements with data-main="1" are content, with "0" they are not; the label
    holds for what lies inside until another label. A container is content if anything in it is."""
    trees = [Tree(p) for p in pages]
    names = sorted({f for t in trees for fs in t.features for f in fs})
    index = {f: k for k, f in enumerate(names)}
    forest = forest_of(trees, index)
    state: list[bool] = []
    for t in trees:
        own = [t.leaf[i] and t.kept[i] for i in range(len(t.parent))]
        for i in range(len(own) - 1, 0, -1):
            own[t.parent[i]] |= own[i]
        state += own
    state = np.array(state, np.int64)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.leaf[inner], state[forest.parent[inner]], state[inner]), 1)
    counts = np.bincount(forest.feature, state[forest.owner], len(index))
    model = Model(index, np.zeros(len(index)), np.zeros((2, 2, 2)))
    steps = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.ties)]
    for k in range(1, rounds + 1):
        belief, pairs = messages(forest, model)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.leaf[inner], pairs[inner])
        grads = ((counts - np.bincount(forest.feature, belief[forest.owner, 1], len(index))) / len(pages) - shrink * model.weights, (seen - expected) / len(pages) - shrink * model.ties)
        for value, g, (m, v) in zip((model.weights, model.ties), grads, steps):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model


def extract_texts(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page: its content blocks in order, one line each."""
    trees = [Tree(p or "") for p in pages]
    belief, _ = messages(forest_of(trees, model.index), model)
    out, base = [], 0
    for t in trees:
        out.append("\n".join(text for text, b in zip(t.texts, belief[base : base + len(t.texts), 1].tolist()) if text is not None and b > 0.5))
        base += len(t.texts)
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20, "html"):
            texts = extract_texts(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    key = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")


def labelled_pages(n: int = 700, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts: with and without telling tags, classes and ids, short and long text everywhere."""
    r = random.Random(seed)
    one = r.choice

    def words(a: int, b: int) -> str:
        return " ".join("".join(one(["ta", "ri", "no", "sel", "um", "e", "pra", "on", "vi"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(1, 18).replace(" ", ", ", r.randint(0, 1)).capitalize() + one([".", ".", ".", "!", "?", ""]) for _ in range(r.randint(a, b)))

    def names(*options: str) -> str:
        value = one(options)
        return one([f' class="{value}"', f' id="{value}"', f' class="{one("abcdef")}{r.randint(1, 9)} {value}"'])

    def links(k: int) -> str:
        return "".join(f'<a href="/{i}">{words(1, 3)}</a> ' for i in range(k))

    def part(tag: str, keyed: tuple[str, ...], inside: str) -> str:
        """An excluded part: by its tag, by its names, or by both."""
        how = r.random()
        if how < 0.4:
            return f'<{tag} data-main="0">{inside}</{tag}>'
        name = "div" if how < 0.8 else tag
        return f'<{name}{names(*keyed)} data-main="0">{inside}</{name}>'

    def menu() -> str:
        items = "".join(f"<li>{links(1)}</li>" for _ in range(r.randint(2, 8)))
        return part("nav", ("nav", "menu", "main-menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toc-menu", "pagination"), one([f"<ul>{items}</ul>", links(5), f"<p>{links(4)}</p>"]))

    def some_text() -> str:
        return one([sentences(1, 4), f"<p>{sentences(1, 6)}</p>", f"<p>{words(1, 4)}</p><p>{sentences(1, 3)}</p>", f"<h3>{words(1, 5)}</h3><p>{sentences(1, 3)}</p>", f"<div>{sentences(1, 5)}</div>"])

    def named(keyed: tuple[str, ...], inside: str) -> str:
        tag = one(["div", "div", "section", "p" if "<" not in inside else "div"])
        return f'<{tag}{names(*keyed)} data-main="0">{inside}</{tag}>'

    def advert() -> str:
        return named(("ad", "ads", "advert", "adverts", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "ad-slot"), some_text())

    def notice() -> str:
        return named(("cookie", "cookie-notice", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "disclaimer", "subscribe", "paywall", "newsletter"), some_text() + one(["", "<button>OK</button>"]))

    def sidebar() -> str:
        return part("aside", ("sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "rail", "popular", "tags", "aside"), one([some_text(), f"<ul><li>{links(1)}</li><li>{links(1)}</li></ul>", f"<h4>{words(1, 3)}</h4>{links(3)}"]))

    def form() -> str:
        kinds = ("search", "login", "signup", "contact-form", "form", "newsletter-form", "searchbox")
        inside = f"<label>{words(1, 3)}</label> <input type=text> <button>{words(1, 1)}</button>" + one(["", f"<p>{sentences(1, 2)}</p>"])
        return one([f'<form action="/s" data-main="0">{inside}</form>', f'<form{names(*kinds)} data-main="0">{inside}</form>'])

    def comments() -> str:
        kinds = ("comments", "comment-list", "reader-comments", "responses", "discussion", "replies", "disqus", "comment-section")
        inner = "".join(f'<{t}{names("comment", "reply", "comment-body", "response")}>{some_text()}</{t}>' for t in [one(["div", "li", "article", "section"])] for _ in range(r.randint(1, 4)))
        tag = one(["div", "section", "ul", "ol"])
        return f'<{tag}{names(*kinds)} data-main="0">{one(["", f"<h3>{words(1, 2)}</h3>"])}{inner}</{tag}>'

    def share() -> str:
        return named(("share", "social", "sharing", "social-links", "follow", "author-box", "byline-share"), one([links(3), words(1, 3)]))

    def header() -> str:
        inside = one([f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 4)}</div>", f"<p>{sentences(1, 2)}</p>", f'<a href="/">{words(1, 2)}</a>']) + one(["", menu()])
        return part("header", ("header", "site-header", "masthead", "topbar", "top", "page-header", "logo", "branding"), inside)

    def footer() -> str:
        inside = one([f"&copy; {words(1, 6)}", f"<p>&copy; 2020 {sentences(1, 2)}</p>", some_text(), links(4), f"{words(1, 2)} &middot; {sentences(1, 2)}"])
        return part("footer", ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "footer-links"), inside)

    def block() -> str:
        kind = r.random()
        if kind < 0.55:
            return f"<p>{sentences(1, 8)}" + one(["</p>", "</p>", ""])
        if kind < 0.63:
            return f"<p>{words(1, 3)}{one(['.', ''])}</p>"
        if kind < 0.68:
            return f"<p><b>{sentences(1, 1)}<br><p>{sentences(1, 3)}</p>"
        if kind < 0.76:
            return f"<h{r.randint(2, 4)}>{words(1, 7)}</h{r.randint(2, 4)}>"
        if kind < 0.83:
            tag = one(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{sentences(1, 2)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if kind < 0.88:
            return f"<blockquote>{one([sentences(1, 3), f'<p>{sentences(1, 3)}</p>'])}</blockquote>"
        if kind < 0.91:
            return f"<pre>{words(3, 12)}\n {words(1, 5)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{sentences(1, 1)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=a.png><figcaption>{sentences(1, 1)}</figcaption></figure>"
        return f'<p>{sentences(1, 2)} <a href="/x">{words(1, 3)}</a> {sentences(1, 2)} <em>{words(1, 2)}</em></p>' if r.random() < 0.7 else f"<div>{sentences(1, 4)}</div>"

    def article() -> str:
        title = f"<h1>{words(1, 9)}{one(['', '.'])}</h1>"
        title = one([title, title, f"<header>{title}</header>", f"<div>{title}</div>", ""])
        blocks = [title] + [block() for _ in range(r.randint(1, 12))]
        for extra in (advert, sidebar, share, form, notice, menu, comments):
            if r.random() < 0.1:
                blocks.insert(r.randint(1, len(blocks)), extra())
        inside = "".join(blocks)
        kind = r.random()
        if kind < 0.45:
            return f'<article data-main="1">{inside}</article>'
        if kind < 0.6:
            return f'<main data-main="1">{inside}</main>'
        named_parts = names("content", "main", "article", "post", "post-body", "entry-content", "story", "article-body", "main-content", "text", "entry", "body-text")
        if kind < 0.9:
            tag = one(["div", "section", "article"])
            return f'<{tag}{named_parts} data-main="1">{inside}</{tag}>'
        return f'<div data-main="1">{inside}</div>'

    out = []
    for _ in range(n):
        before = [f() for f in (header, menu, notice, advert, form) if r.random() < 0.4]
        after = [f() for f in (comments, sidebar, share, advert, notice, form) if r.random() < 0.35] + [footer() for _ in range(r.random() < 0.8)]
        r.shuffle(before)
        body = "".join(before) + one([article(), f"<main>{article()}</main>", f"<div>{article()}</div>", f'<div{names("container", "wrapper", "page", "row", "layout")}>{article()}</div>']) + "".join(after)
        out.append(f"<html><head><title>{words(1, 5)}</title><script>x='<p>';</script></head><body>{body}</body></html>")
    return out
