"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
                  "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset(("br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NEVER_TEXT = frozenset("script style noscript template head title iframe object embed svg math canvas audio video map "
                       "button select option optgroup datalist textarea input label".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer foot gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup topbar "
    "promo promotion promoted related recommended reply replies respond share sharing sidebar sidebars social sponsor sponsored "
    "subscribe subscription toolbar widget".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template".split())
IMPLIED_END = {  # start tag -> open elements that it ends, within the element named last
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)),
    "option": (("option",), ("select",)),
}

_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A DOM element; ``items`` holds its text pieces and child nodes in page order."""

    __slots__ = ("tag", "attrs", "items", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "skip")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []


class _Tree(HTMLParser):
    """Lenient DOM builder: implied end tags, unclosed and stray tags, truncated pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.at = self.root

    def _open(self, names, until) -> Node | None:
        node = self.at
        while node is not None and node.tag not in until:
            if node.tag in names:
                return node
            node = node.parent
        return None

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.root.attrs.update((k, v or "") for k, v in attrs)
            return
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in CLOSES_P:
            p = self._open(("p",), ("table", "button", "td", "th"))
            if p is not None:
                self.at = p.parent
        if tag in IMPLIED_END:
            names, until = IMPLIED_END[tag]
            done = self._open(names, until)
            while done is not None:
                self.at = done.parent
                done = self._open(names, until)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def _leave_head(self):
        """The end tag of a head is optional: what a head cannot hold ends it."""
        if self.at.tag == "head":
            self.at = self.at.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "use", "circle", "rect", "g"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        # an inline end tag does not reach through a block, a block end tag closes whatever is open inside
        node = self.at
        while node is not None and node.tag != tag:
            if tag not in BLOCK and node.tag in BLOCK:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        self.at.items.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.at.items.append(data[6:])


def parse(html: str) -> Node:
    tree = _Tree()
    last = html.rfind("<")
    if last >= 0 and re.match("<[a-zA-Z/!?]", html[last:last + 2]) and html.find(">", last) < 0:
        html = html[:last]  # the page ends inside a tag, which is no text
    tree.feed(html)
    tree.close()
    return tree.root


def _named_boilerplate(node: Node) -> bool:
    if node.tag in ("html", "body", "article", "main") or node.tag in HEADINGS:
        return False
    if node.attrs.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in node.attrs:
        return True
    if node.attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", node.attrs.get("style", ""), re.I):
        return True
    for name in (node.attrs.get("class", "") + " " + node.attrs.get("id", "")).split():
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        if parts and (parts[0] in BOILERPLATE_NAMES or parts[-1] in BOILERPLATE_NAMES):
            return True
    return False


def _header_like(node: Node) -> bool:
    """A header element or class: inside an article it may hold the title."""
    names = (node.attrs.get("class", "") + " " + node.attrs.get("id", "")).lower()
    return node.tag == "header" or "header" in re.findall("[a-z]+", names)


def _order(root: Node) -> list[Node]:
    """Nodes in page order, parents before children (no recursion: pages can nest deeply)."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.items) if not isinstance(c, str))
    return out


def measure(root: Node) -> list[Node]:
    """Composite text density of every node and the density sum of its children.

    With C characters, T tags, LC link characters and LT link tags below a
    node (body's as Cb and LCb): density = C/T * log of (C/LC * T/LT) to the
    base ln(C/(C-LC) * LC + LCb/Cb * C + e); a zero denominator counts as 1.
    """
    nodes = _order(root)
    for node in nodes:
        parent = node.parent
        inside = parent is not None and parent.skip
        heading = node.tag in HEADINGS
        node.skip = inside and not (heading and _header_like(parent) and _in_article(parent)) or (
            node.tag in NEVER_TEXT or node.tag in BOILERPLATE or node.tag == "header" or _named_boilerplate(node))
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(nodes):
        own = 0 if node.skip else sum(len(" ".join(t.split())) for t in node.items if isinstance(t, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None and not (node.skip and not node.chars):
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags + (node.tag == "a")
    body_c, body_lc = root.chars or 1, root.link_chars
    for node in nodes:
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars, node.link_tags
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / ((c - lc) or 1) * lc + body_lc / body_c * c + math.e)
        ratio = (c / (lc or 1)) * (t / (lt or 1))
        node.density = c / t * max(0.0, math.log(max(ratio, 1.0)) / math.log(base)) if base > 1 else c / t * math.log(max(ratio, 1.0) + 1e-12)
    for node in nodes:
        node.total = sum(c.density for c in node.items if not isinstance(c, str))
    return nodes


def _in_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def main_nodes(root: Node) -> list[Node]:
    """The selected subtrees, in page order.

    The node of the largest density sum is sought (the first of equal ones);
    the least density on its path to the body is the threshold.  Nodes beside
    that path at the threshold or above give their own subtree's node of the
    largest density sum, headings and paragraphs themselves.  A selected node inside an <article> or <main>
    is widened to it, the unit that the page itself names.
    """
    nodes = measure(root)
    alive = [n for n in nodes if not n.skip and n.chars]
    if not alive:
        return []
    body = next((n for n in alive if n.tag == "body"), root)
    best = max(alive, key=lambda n: n.total)
    if best.total <= 0:
        return [body]
    threshold, path, node = math.inf, [], best
    while node is not None:
        threshold = min(threshold, node.density)
        path.append(node)
        if node is body:
            break
        node = node.parent
    found = [best]
    for above, below in zip(path[1:], path):
        for c in above.items:
            if not isinstance(c, str) and c is not below and not c.skip and c.chars and c.density >= threshold:
                inner = max((x for x in _order(c) if not x.skip and x.chars), key=lambda x: x.total)
                found.append(inner if inner.total > c.total else c)
    place = {n: i for i, n in enumerate(nodes)}
    wide = sorted({_widened(n) for n in found}, key=place.__getitem__)
    return [n for i, n in enumerate(wide) if not any(_holds(o, n) for o in wide[:i])]


def _widened(node: Node) -> Node:
    """The outermost article or main around a node, else the node."""
    out, at = node, node
    while at is not None:
        if at.tag in ("article", "main"):
            out = at
        at = at.parent
    return out


def _holds(node: Node, inner: Node | None) -> bool:
    while inner is not None:
        if inner is node:
            return True
        inner = inner.parent
    return False


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, white space collapsed, empty blocks left out."""
    out: list[str] = []
    piece: list[str] = []

    def flush():
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            out.append(text)

    stack: list = [("open", node)]
    while stack:
        what, x = stack.pop()
        if what == "text":
            piece.append(x)
            continue
        if what == "close":
            flush()
            continue
        if x.skip:
            if _header_like(x) and _in_article(x):
                kept = [c for c in _order(x) if c.tag in HEADINGS and not c.skip]
                stack.extend(("open", c) for c in reversed(kept))
            continue
        if x.tag in BLOCK:
            flush()
            stack.append(("close", x))
        stack.extend(("text", c) if isinstance(c, str) else ("open", c) for c in reversed(x.items))
    flush()
    return out


def extract(html: str | None) -> str:
    """Main text of one page: blocks in page order joined by one newline ('' for null or text-free pages)."""
    if not html:
        return ""
    return "\n".join(b for n in main_nodes(parse(html)) for b in blocks(n))


def main_text(html: Column) -> Column:
    """Main text of a column of pages (null, empty and text-free pages: empty).

    Whole pages, nothing capped, row by row: repeated rows give the same
    text, an empty table gives no rows, other columns are not read.  Of
    nodes with equal density sums the first in page order is taken.
    """
    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([extract(h) for h in s], dtype="object")

    return text(html)
