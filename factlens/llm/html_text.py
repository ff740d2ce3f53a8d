"""Operator 3: main text of web pages by composite text density.

The page becomes a tree. Scripts, styles, form controls and what the head holds are never text. For each node with C
characters, T tags, LC characters and LT tags in links, the density is

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LC_body / C_body * C + e))

(counts of 0 taken as 1), and its sum is that of its block-level children's densities (bold text or a link in a paragraph is
no part of its own). The node with the largest sum is the article; where an article or main element holds it, that element is
the article, so its headline and short paragraphs stay. The smallest density on its path to the body is the threshold. The
article's subtree is kept whole, and elsewhere every largest-sum subtree whose density reaches the threshold.

Of the kinds that are no part of an article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) a
node is one by its element, its role, or a whole class name or id. It is left out before densities are computed, unless it is
a wrapper: all article and main elements of the page are in it, or there are none and a form or a node with such a name holds
over half of the body's text. Reader comments are never wrappers, and an article's own header with its headline stays.

Parsing and choice take time in proportion to the page's length, at any depth.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_NEVER = _RAW | set("head select button option template datalist input".split())
_BLOCK = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split())
_CLOSES_P = _BLOCK - set("html body caption colgroup thead tbody tfoot tr td th".split())
_P_SCOPE = ("td", "th", "table", "button", "caption", "object")
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_ELEMENTS = set("nav header footer aside dialog menu".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_COMMENT = set("comment comments commentlist respond disqus reply replies".split())
_KINDS = _COMMENT | set("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead login signup form".split())
#: Parts that may stand beside one of the kinds in a name and leave it one: cookie-notice, site-footer, comment-list, top-nav2.
_BESIDE = _KINDS | set("site page main top bottom left right primary secondary global footer list item items section area block box bar banner slot unit text link links message links inner outer mobile desktop sticky fixed user reader".split())
_OF_POSTS = set("post entry article thread".split())
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)\s*>")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}
_PART = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("name", "kids", "kind", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "headed")

    def __init__(self, name: str, kind: str = ""):
        self.name, self.kids, self.kind, self.drop = name, [], kind, kind == "never"

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str) and not k.drop]


def _kind_of_name(value: str) -> str:
    """comment, named or "": of one whole class name or id, all of whose parts (between - and _) are of a kind or stand beside one."""
    parts = set(_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))
    if parts & _COMMENT and parts <= _BESIDE | _OF_POSTS:
        return "comment"
    return "named" if parts & _KINDS and parts <= _BESIDE else ""


def _kind(name: str, attrs: dict[str, str], in_article: bool) -> str:
    if name in _NEVER:
        return "never"
    found = set()
    if name not in ("html", "body", "main"):
        found = {_kind_of_name(x) for key in ("class", "id") for x in attrs.get(key, "").split()}
    if "comment" in found:
        return "comment"
    if name in _ELEMENTS or attrs.get("role", "").strip().lower() in _ROLES:
        return "headline" if name == "header" and in_article else "element"
    return "named" if name == "form" or "named" in found else ""


class _Reader:
    """Tags of a page, by the HTML rules: quotes count only after an equals sign, and an attribute's quote that never closes is a part of an unquoted value."""

    def __init__(self, source: str):
        self.source, self.open = source, {'"': True, "'": True}

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from `at` on, the place after the tag's >, and whether the tag ends in />."""
        source, n, out = self.source, len(self.source), {}
        while True:
            m = _ATTR_NAME.match(source, at)
            slash, at = m[0].rstrip().endswith("/") and m[1] is None, m.end()
            if at >= n:
                return out, n, slash
            if m[1] is None:
                return out, at + 1, slash  # at the >
            value, eq = "", _EQUALS.match(source, at)
            if eq:
                at, quote = eq.end(), source[eq.end() : eq.end() + 1]
                stop = source.find(quote, at + 1) if quote and self.open.get(quote) else -1
                if stop >= 0:
                    value, at = source[at + 1 : stop], stop + 1
                else:
                    if quote in self.open:
                        self.open[quote] = False  # none further on either
                    v = _BARE.match(source, at)
                    value, at = v[0], v.end()
            out.setdefault(m[1].lower(), value)


def parse(source: str) -> Node:
    """The tree, with the implied ends of paragraphs, list items and table parts. A node's kids are nodes and strings."""
    root = Node("html")
    stack = [root]
    where: dict[str, list[int]] = {}  # places in the stack, by name
    blocks = [0]
    reader, at, n = _Reader(source), 0, len(source)

    def last(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    def cut(depth: int) -> None:
        """Closes what is open from this place of the stack on."""
        while len(stack) > depth:
            name = stack.pop().name
            where[name].pop()
            if name in _BLOCK:
                blocks.pop()

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            stack[-1].kids.append(source[at:])
            break
        if lt > at:
            stack[-1].kids.append(source[at:lt])
        m = _SIMPLE.match(source, lt)
        attrs, closed = {}, False
        if m:
            ends, name, at = bool(m[1]), m[2].lower(), m.end()
        elif m := _TAG_NAME.match(source, lt):
            ends, name = source[lt + 1] == "/", m[1].lower()
            attrs, at, closed = reader.attributes(m.end())
        elif source.startswith("<!--", lt):
            if source.startswith((">", "->"), lt + 4):
                at = source.index(">", lt + 4) + 1
            else:
                end = _COMMENT_END.search(source, lt + 4)
                at = end.end() if end else n
            continue
        elif source[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 2 < n:
            end = source.find(">", lt + 2)
            at = end + 1 if end >= 0 else n
            continue
        else:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        if ends:
            place = last((name,))
            if place and (name in _BLOCK or place > blocks[-1]):  # an inline end tag does not end a block
                cut(place)
            elif name in ("p", "br"):
                stack[-1].kids.append(Node(name))
            continue
        if name in ("html", "body"):
            continue
        if name in _CLOSES_P and (place := last(("p",))) > last(_P_SCOPE):
            cut(place)
        if name in _SIBLINGS:
            close, within = _SIBLINGS[name]
            scope = last(within)
            inside = [where[x][bisect_right(where[x], scope)] for x in close if where.get(x) and where[x][-1] > scope]
            if inside:  # the outermost of them in this list or table
                cut(min(inside))
        if name == "a" and (place := last(("a",))) > blocks[-1]:
            cut(place)
        new = Node(name, _kind(name, attrs, bool(last(("article", "main")))))
        stack[-1].kids.append(new)
        if name in _VOID or closed and name in ("svg", "math", "path"):
            continue
        if name in _RAW:
            end = _RAW_END[name].search(source, at) if name != "plaintext" else None
            at = end.end() if end else n
            continue
        where.setdefault(name, []).append(len(stack))
        if name in _BLOCK:
            blocks.append(len(stack))
        stack.append(new)
    return root


def _walk(root: Node) -> list[Node]:
    """Parents before children; dropped nodes and what is in them are left out."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.nodes()))
    return out


def _leave_out(root: Node) -> None:
    """Marks the nodes of a kind that is no part of an article, but for wrappers."""
    nodes = _walk(root)
    for node in reversed(nodes):
        kids = [k for k in node.nodes() if k.kind != "comment"]
        node.chars = sum(len(k.strip()) for k in node.kids if isinstance(k, str)) + sum(k.chars for k in kids)
        node.total = (node.name in ("article", "main")) + sum(k.total for k in kids)
        node.headed = node.name in _HEADINGS or any(k.headed for k in kids)
    for node in nodes:
        if node.kind and not (node.kind == "headline" and node.headed):
            wraps = node.total == root.total if root.total else node.kind == "named" and 2 * node.chars > root.chars
            node.drop = node.kind == "comment" or not wraps


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        kids = node.nodes()
        node.chars = sum(len(k.strip()) for k in node.kids if isinstance(k, str)) + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        link = node.name == "a"
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = node.tags if link else sum(k.link_tags + (k.name == "a") for k in kids)
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e) + math.e - 1)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / base, 1e-9)
        else:
            node.density = 0.0
        kids = node.nodes()
        node.total = sum(k.density for k in kids if k.name in _BLOCK)
        node.best = node  # of the subtree: the largest sum, the outermost and first of equals
        for k in kids:
            if k.best.total > node.best.total:
                node.best = k.best


def _content(body: Node) -> set[int]:
    nodes = _walk(body)
    _measure(nodes)
    above = {id(k): node for node in nodes for k in node.nodes()}
    best = body.best if body.best.total > 0 else body
    node = best
    while node is not None and node.name not in ("article", "main"):
        node = above.get(id(node))
    best = node or best
    path, threshold, node = {id(best)}, best.density, best
    while node is not body:
        node = above[id(node)]
        path.add(id(node))
        threshold = min(threshold, node.density)
    keep, stack = {id(best)}, [body]
    while stack:
        node = stack.pop()
        if node is best:
            continue
        if id(node) not in path and node.density >= threshold and node.chars:
            chosen = node.best if node.total > 0 else node
            keep.add(id(chosen))
            if chosen is node:
                continue
        stack.extend(node.nodes())
    return keep


def main_text(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    _leave_out(root)
    keep = _content(root)
    blocks, words = [], []

    def end() -> None:
        if line := " ".join("".join(words).split()):
            blocks.append(line)
        words.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            if inside:
                words.append(html.unescape(node) if "&" in node else node)
        elif not node.drop:
            inside = inside or id(node) in keep
            if node.name in _BLOCK:
                end()
                stack.append((None, False))
            elif node.name == "br":
                words.append(" ")
            stack.extend((k, inside) for k in reversed(node.kids))
    end()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, then text and n_chars (code points).

    A null, empty or text-free page has an empty text. Unclosed, misnested and unknown elements are parsed as far as they
    go; a page of any length and depth is read whole. Repeated rows are kept. Columns not named are not read. No rows give
    no rows.
    """
    importable(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x if isinstance(x, str) else None) for x in batch["__html"]]
            yield batch.drop(columns="__html").assign(text=text, n_chars=[len(t) for t in text])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html_col).cast("string").alias("__html")).mapInPandas(run, f"{kinds}, text string, n_chars long")
