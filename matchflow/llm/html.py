"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, discounted by the share of
their text that lies in links; the container with most points and its telling siblings are
kept. Parts that are never article text (menus, forms, notices, comments and so on, by tag
or by the words of class, id and role) are cut before scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame

from matchflow.llm.common import column, map_rows

# Tags by what they do.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes", "svg", "math"}
DROP = RAW | {"head", "nav", "aside", "footer", "form", "button", "select", "input", "label", "fieldset", "menu", "dialog",
              "object", "embed", "canvas", "audio", "video", "map", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul"}
SCORED = {"p", "pre", "blockquote", "td", "dd", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dt", "dd", "li", "legend", "summary"}
UNLIKELY = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
            "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation",
            "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "recommended", "remark", "replies",
            "respond", "share", "sharing", "sidebar", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
            "complementary", "contentinfo", "alert", "alertdialog", "dialog", "search", "discussion", "reactions"}
COMMENTS = {"comment", "comments", "disqus", "remark", "replies", "respond", "discussion", "reactions"}
LIKELY = {"article", "content", "main", "body", "entry", "hentry", "post", "story", "text", "column"}

#: A quote without a partner in the rest of the page is a character like others, so every tag that begins also ends.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]|\"(?=[^\"]*\Z)|'(?=[^']*\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAMES = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    """An element. ``depth`` and ``blocks`` count it and its ancestors, and those that are blocks;
    ``inside``: it is or lies in an article or main element."""

    __slots__ = ("tag", "parent", "kids", "weight", "points", "chars", "linked", "depth", "blocks", "inside")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0.0):
        self.tag, self.parent, self.weight = tag, parent, weight
        self.kids: list = []
        self.points = 0.0
        self.chars = self.linked = 0
        self.depth = parent.depth + 1 if parent else 0
        self.blocks = (parent.blocks if parent else 0) + (tag in BLOCK)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)


class Open:
    """The open elements: the innermost, and those of each tag, so that no search walks up the tree."""

    def __init__(self):
        self.root = self.node = Node("#root", None)
        self.by_tag: dict[str, list[Node]] = {}

    def enter(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        self.node = node

    def leave_to(self, up: Node) -> None:
        while self.node is not up:
            self.by_tag[self.node.tag].pop()
            self.node = self.node.parent

    def last(self, tags: set[str]) -> Node | None:
        return max((o[-1] for t in tags if (o := self.by_tag.get(t))), key=lambda n: n.depth, default=None)

    def close(self, tags: set[str], bounds: set[str]) -> None:
        """Leave the innermost element of the tags, unless one of the bounds lies within it."""
        found = self.last(tags)
        if found and ((bound := self.last(bounds)) is None or bound.depth < found.depth):
            self.leave_to(found.parent)


class Page:
    """The tags of a page, read once: (start, end, closing, name, attributes, self-closing), without
    those inside raw text, which ends at its first end tag. ``until``: for each start tag the number
    of its own end tag, nested ones counted. Up to each tag: how many characters of paragraphs
    (outside of links and of readers' comments) and how many article or main elements came."""

    def __init__(self, html: str):
        self.tags: list[tuple] = []
        self.until: dict[int, int] = {}
        self.prose, self.articles = [0], [0]
        starts: dict[str, list[int]] = {}
        ends: dict[str, re.Pattern] = {}
        at = link = 0
        paragraph, prose, articles = False, 0, 0
        while m := TOKEN.search(html, at):
            if paragraph and not link:
                prose += len(html[at:m.start()].strip())
            at, name, full = m.end(), (m[2] or "").lower(), (m[3] or "").rstrip().endswith("/")
            k = len(self.tags)
            if name and m[1]:
                if starts.get(name):
                    self.until[starts[name].pop()] = k
            elif name and not full and name not in VOID:
                starts.setdefault(name, []).append(k)
            if name == "a":
                link = 0 if m[1] else 1
            elif name in BLOCK:
                paragraph = name == "p" and not m[1]
            articles += name in ("article", "main") and not m[1]
            self.tags.append((m.start(), m.end(), bool(m[1]), name, m[3] or "", full, m[0] if not name else ""))
            self.prose.append(prose)
            self.articles.append(articles)
            if name in RAW and not m[1] and not full:
                if name not in ends:
                    ends[name] = re.compile(rf"</{re.escape(name)}\b", re.I)
                stop = ends[name].search(html, at)
                at = stop.start() if stop else len(html)

    def holds(self, k: int, last: int) -> tuple[bool, bool]:
        """Do the tags from k to last hold more than half of the paragraphs, and all articles?"""
        return (2 * (self.prose[last] - self.prose[k]) > self.prose[-1],
                self.articles[last] - self.articles[k] == self.articles[-1] > 0)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in ATTR.finditer(raw)} if raw.strip(" /") else {}


def _words(attrs: dict[str, str]) -> set[str]:
    return set(NAMES.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower()))


def _unwanted(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in DROP or tag == "header" and not inside_article:
        return True
    if _hidden(attrs):
        return tag not in ("html", "body")
    if tag in ("html", "body", "article", "main"):
        return False
    return bool(_words(attrs) & UNLIKELY)


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def parse(html: str, unwrap: bool = False) -> Node:
    """A tree of the parts that may be article text; leaves are strings.

    An unwanted element is cut with all it holds. One that wraps the article is taken for a plain
    element instead, and what it holds is looked at by itself: one with more than half of the page's
    paragraph text that holds all its article and main elements, or has no end tag; with
    ``unwrap`` any that has more than half of it. Raw text, hidden parts and readers' comments are
    always cut. A cut element without an end tag reaches to the end of the page if it is raw text or a part of
    the page's frame, else it is its start tag alone."""
    page, here = Page(html), Open()
    at = k = 0
    while k < len(page.tags):
        start, end, closing, tag, raw, full, other = page.tags[k]
        if start > at:
            here.node.kids.append(html[at:start])
        at, k = end, k + 1
        if not tag:
            if other.startswith("<![CDATA["):
                here.node.kids.append(other[9:].removesuffix("]]>"))
            continue
        if closing:
            up = here.last({tag})
            if up and (tag in BLOCK or up.blocks == here.node.blocks):
                here.leave_to(up.parent)
            elif tag == "p" and up is None:
                here.node.kids.append(Node("p", here.node))
            continue
        attrs = _attributes(raw)
        if _unwanted(tag, attrs, here.node.inside):
            last = k
            if tag not in VOID and not full:
                own = page.until.get(k - 1)
                framed = tag in RAW or tag in ("nav", "footer", "aside", "form", "header")
                last = own + 1 if own is not None else len(page.tags) if framed else k
                prose, articles = page.holds(k, last)
                wraps = prose and (unwrap or articles or own is None) and not (tag in RAW or tag == "head" or _hidden(attrs) or _words(attrs) & COMMENTS)
                if not wraps and own is None and framed:
                    at, last = len(html), len(page.tags)
                elif not wraps and last > k:
                    at = page.tags[last - 1][1]
            if last == k or not wraps:
                k = last
                here.node.kids.append(Node("#cut", here.node) if tag in BLOCK else " ")
                continue
        if tag in CLOSES_P:
            here.close({"p"}, {"article", "section", "div", "td", "th", "table", "blockquote", "main", "body", "html", "li", "dd", "figure"})
        if tag == "li":
            here.close({"li"}, {"ul", "ol", "dir"})
        elif tag in ("dd", "dt"):
            here.close({"dd", "dt"}, {"dl"})
        elif tag in ("td", "th"):
            here.close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            here.close({"tr"}, {"table"})
        child = Node(tag, here.node, 25.0 * bool(_words(attrs) & LIKELY) + {"article": 40.0, "main": 30.0}.get(tag, 0.0))
        here.node.kids.append(child)
        if tag not in VOID and not (full and tag not in BLOCK):
            here.enter(child)
    if at < len(html):
        rest = html[at:]
        here.node.kids.append(rest[:rest.rfind("<")] if re.search("<[/A-Za-z!?]", rest[rest.rfind(">") + 1:]) else rest)
    return here.root


def _ancestors(node: Node, tags: set[str]) -> Iterator[Node]:
    while node is not None:
        if node.tag in tags:
            yield node
        node = node.parent


def measure(root: Node) -> list[Node]:
    """Fill in characters, linked characters and points of every node; returns the nodes."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    commas: dict[int, int] = {}
    for node in reversed(order):
        n = c = 0
        for k in node.kids:
            if isinstance(k, Node):
                node.chars += k.chars
                node.linked += k.linked
                c += commas.get(id(k), 0) if k.tag not in BLOCK else 0
            else:
                n += len(SPACE.sub(" ", k).strip())
                c += len(re.findall("[,،、，]", k))
        node.chars += n
        if node.tag == "a":
            node.linked = node.chars
        commas[id(node)] = c
    for node in order:
        if node.tag in SCORED and node.chars:
            density = node.linked / node.chars
            points = (1 + commas[id(node)] + min(node.chars / 100, 3)) * (1 - density)
            up, share = node.parent, 1.0
            for level in range(3):
                if up is None:
                    break
                up.points += points * share
                up, share = up.parent, (0.5, 1 / 3)[level] if level < 2 else 0
    for node in order:
        if node.chars:
            node.points = (node.points + node.weight * (node.points > 0 or node.tag in ("article", "main"))) * (1 - node.linked / node.chars)
    return order


def best(root: Node) -> list[Node]:
    """The container with most points, with those siblings that look like its continuation;
    inside an article or main element the whole element is the container."""
    order = measure(root)
    full = [n for n in order if n.chars and n.tag != "#root"]
    if not full:
        return [root]
    top = max(full, key=lambda n: n.points)
    if top.points <= 0:
        return [next((n for n in order if n.tag == "body"), root)]
    outer = [n for n in _ancestors(top, {"article"})] or [n for n in _ancestors(top, {"main"})]
    if outer:
        return [outer[-1]]
    if top.tag in SCORED and top.parent is not None:
        top = top.parent
    if top.parent is None or top.tag in ("body", "html"):
        return [top]
    least = max(10.0, 0.2 * top.points)
    kept = []
    for k in top.parent.kids:
        if isinstance(k, Node) and (k is top or k.points >= least or k.tag in SCORED and k.chars
                                    and (k.chars >= 80 and k.linked < 0.25 * k.chars or k.tag[0] == "h" and not k.linked)):
            kept.append(k)
    return kept


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order joined by a line feed; white space inside a block is one space."""
    blocks, parts = [], []

    def cut() -> None:
        if s := SPACE.sub(" ", unescape("".join(parts))).strip():
            blocks.append(s)
        parts.clear()

    stack: list = list(reversed(nodes))
    while stack:
        k = stack.pop()
        if k is None:
            cut()
        elif isinstance(k, str):
            parts.append(k)
        elif k.tag == "br":
            parts.append(" ")
        else:
            if k.tag in BLOCK or k.tag == "#cut":
                cut()
                stack.append(None)
            stack += reversed(k.kids)
    cut()
    return "\n".join(blocks)


def extract(html: str) -> str:
    """The main text; where every paragraph lay in parts that were cut, those that wrap most of them are opened."""
    if not html:
        return ""
    return text_of(best(parse(html))) or text_of(best(parse(html, unwrap=True)))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page from its whole html; null html and pages without text
    give an empty text. Null or repeated ids and urls are passed on, each row gives a row;
    broken markup (missing end tags, an end inside a tag) is read as far as it goes."""
    schema = f"{id_col} {pages.schema[id_col].dataType.simpleString()}, {url_col} {pages.schema[url_col].dataType.simpleString()}, text string"

    def run(batch) -> Iterator[dict]:
        yield {id_col: batch.column(0), url_col: batch.column(1), "text": [extract(h) for h in column(batch, 2)]}

    return map_rows(pages.select(id_col, url_col, html_col), schema, run)
