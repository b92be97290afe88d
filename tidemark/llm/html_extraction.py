"""Main text of HTML pages from flat text blocks.

A page is cut at block-level tags into flat text blocks. A decision tree, trained on the small labelled table below,
classifies each block by its word count and link density, by those of the block before and the block after, by whether
it is a heading, and by its place: in an element that is apart from the article, in a form, in the article, or none of
these. In an article, and where a page has none, the neighbours tell a linked line from a list of links, a short
paragraph from a slogan, and a heading of the text from one of a menu. The blocks classified as content are the main
text. Reading a page takes time linear in its length, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Element names of HTML. DROPPED: what they hold is never text of the page.
DROPPED = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "textarea", "button"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
APART = {"nav", "aside", "footer", "menu", "dialog", "address"}
FORM = {"form", "fieldset"}
BODY = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words that names of classes, ids and roles are made of: of what is apart from the article, of the article, of either.
APART_WORDS = set("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets banner ad ads advert adverts advertisement advertising sponsor sponsored promo promos cookie cookies consent notice gdpr newsletter subscribe signup login share sharing social related recommended popular comment comments replies respond disqus pagination pager tags toolbar popup modal overlay copyright legal alert complementary contentinfo".split())
BODY_WORDS = set("article post entry story main content body maincontent articlebody text".split())
EITHER_WORDS = set("site page top bottom left right global primary secondary box block area list wrapper container section inner bar links item items posts meta form".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACE = re.compile(r"\s+")


def place_by_name(names: str) -> float:
    """-1 if a class, id or role names something apart, 1 if one names the article, else 0.

    A name counts if it is made of known words only: "cookie-notice" does, "has-sidebar" says something else. The header
    of an article holds its title.
    """
    found = 0.0
    for name in names.lower().split():
        words = set(NAME_PARTS.findall(name))
        if not words or not words <= APART_WORDS | BODY_WORDS | EITHER_WORDS:
            continue
        apart = words & APART_WORDS
        if apart and not (apart == {"header"} and words & BODY_WORDS):
            return -1.0
        if words & BODY_WORDS and not apart:
            found = 1.0
    return found


@dataclass
class Block:
    text: str
    words: int
    link_share: float
    place: float  # -1 in an element apart from the article, -0.5 in a form, 1 in the article, 0 in none of these
    heading: int


class _Stack:
    """Open elements, with where each name is open, so that no tag needs a walk through them."""

    def __init__(self):
        self.open: list[tuple[str, float, bool]] = []  # name, place, dropped
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, place: float, dropped: bool) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, place, dropped))

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            self.at[self.open.pop()[0]].pop()

    def close(self, name: str) -> None:
        """Close the innermost element of that name with all in it; nothing if there is none."""
        if self.at.get(name):
            self.cut(self.at[name][-1])

    def top(self) -> tuple[str, float, bool]:
        return self.open[-1] if self.open else ("", 0.0, False)

    def heading(self) -> int:
        return int(any(self.at.get(name) for name in HEADINGS))


def _place(name: str, attributes: str, above: float) -> float:
    """The place of an element: an article's or main part's own, whatever it stands in, else what holds above it."""
    if name in ("html", "body"):
        return above
    named = place_by_name(" ".join(map("".join, NAMES.findall(attributes)))) if attributes else 0.0
    if name in BODY:
        return -1.0 if named < 0 else 1.0
    if name in APART or named < 0 or name == "header" and above <= 0:
        return -1.0
    if name in FORM:
        return min(above, -0.5)
    return 1.0 if above == 0 and named > 0 else above


def blocks(page: str | None) -> list[Block]:
    """The page's non-empty flat text blocks in order; hidden elements, scripts and the head are left out."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack, links, at, page = _Stack(), 0, 0, page or ""

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = len(html.unescape(" ".join(p for p, link in parts if link)).split())
                words = len(text.split())
                out.append(Block(text, words, min(1.0, linked / words), stack.top()[1], stack.heading()))
            parts.clear()

    while at < len(page):
        tag = TAG.search(page, at)
        end = tag.start() if tag else len(page)
        if end > at and not stack.top()[2]:
            parts.append((page[at:end], links > 0))
        if tag is None:
            break
        at = tag.end()
        name, attributes = (tag[2] or "").lower(), tag[3] or ""
        if not name:
            continue
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                flush()
            stack.close(name)
            continue
        if name in BLOCK:
            flush()
            links = 0
            # An open paragraph ends where another block begins; list items and cells end where the next one begins.
            if stack.top()[0] == "p" or name in ("li", "td", "th", "tr", "dd", "dt") and stack.top()[0] == name:
                stack.cut(len(stack.open) - 1)
            elif name == "p":
                stack.close("p")
        if name in ("br", "wbr"):
            if name == "br" and not stack.top()[2]:
                parts.append((" ", False))
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "a":
            links += 1
        _, above, dropped = stack.top()
        hidden = bool(attributes) and name not in ("html", "body") and HIDDEN.search(attributes) is not None
        stack.push(name, _place(name, attributes, above), dropped or name in DROPPED or hidden)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            stack.cut(len(stack.open) - 1)
    flush()
    return out


# The labelled table, pages as their blocks in order: words, link density, place, heading, content or not.
LABELLED = [
    # An article among menus, an advert and a footer; in it a linked line, a list of links, and paragraphs of one word.
    [(1, 1.0, -1, 0, 0), (1, 1.0, -1, 0, 0), (2, 1.0, -1, 0, 0), (9, 0.0, -1, 0, 0), (8, 0.0, 1, 1, 1), (60, 0.0, 1, 0, 1), (1, 0.0, 1, 0, 1), (75, 0.05, 1, 0, 1), (3, 1.0, 1, 0, 1), (40, 0.0, 1, 0, 1),
     (4, 0.0, 1, 1, 1), (6, 0.0, 1, 0, 1), (5, 0.4, 1, 0, 1), (120, 0.1, 1, 0, 1), (6, 1.0, 1, 0, 0), (7, 1.0, 1, 0, 0), (5, 0.9, 1, 0, 0), (14, 0.0, -1, 0, 0)],
    # Another, with its comments, a sidebar and a newsletter form.
    [(30, 0.0, -1, 0, 0), (5, 0.0, 1, 1, 1), (2, 0.0, 1, 0, 1), (90, 0.0, 1, 0, 1), (16, 0.5, 1, 0, 1), (50, 0.0, 1, 0, 1), (12, 0.0, 1, 0, 1), (2, 1.0, 1, 0, 0), (2, 1.0, 1, 0, 0), (3, 0.0, -0.5, 0, 0), (2, 0.0, -0.5, 0, 0),
     (1, 0.0, -1, 1, 0), (25, 0.0, -1, 0, 0), (80, 0.0, -1, 0, 0), (45, 0.1, -1, 0, 0), (4, 0.0, -1, 1, 0), (7, 1.0, -1, 0, 0), (10, 0.0, -1, 0, 0)],
    # Articles of short lines, right after menus and between lists of links.
    [(1, 1.0, -1, 0, 0), (1, 1.0, -1, 0, 0), (2, 0.0, 1, 1, 1), (1, 0.0, 1, 0, 1), (2, 0.0, 1, 0, 1), (1, 0.0, 1, 1, 1), (2, 0.0, 1, 1, 1), (3, 0.0, 1, 0, 1), (8, 0.0, -1, 0, 0)],
    [(3, 1.0, -1, 0, 0), (1, 0.0, 1, 1, 1), (3, 0.0, 1, 0, 1), (1, 0.0, 1, 0, 1), (2, 0.5, 1, 0, 1), (4, 1.0, 1, 0, 0), (6, 1.0, 1, 0, 0), (4, 1.0, 1, 0, 0), (2, 0.0, 1, 1, 1), (1, 0.0, 1, 0, 1), (2, 0.0, 1, 0, 1), (11, 0.0, -1, 0, 0)],
    [(2, 1.0, -1, 0, 0), (30, 0.1, 1, 0, 1), (1, 0.0, 1, 0, 1), (5, 1.0, 1, 0, 0), (3, 1.0, 1, 0, 0), (2, 0.0, 1, 0, 1), (1, 0.0, 1, 1, 1), (1, 0.0, 1, 0, 1), (12, 0.0, -1, 0, 0), (15, 0.0, -1, 0, 0)],
    [(5, 0.0, -1, 0, 0), (1, 0.0, 1, 0, 1), (16, 0.0, -1, 0, 0)], [(2, 0.0, 1, 0, 1)], [(2, 0.0, 1, 1, 1), (5, 1.0, -1, 0, 0)],
    # Articles of long sections with headings, captions between lists of links, and an ending of one word.
    [(3, 1.0, -1, 0, 0), (2, 0.0, 1, 1, 1), (110, 0.0, 1, 0, 1), (3, 0.0, 1, 1, 1), (90, 0.0, 1, 0, 1), (1, 0.0, 1, 1, 1), (6, 1.0, 1, 0, 0), (7, 1.0, 1, 0, 0), (12, 0.0, 1, 0, 1), (5, 1.0, 1, 0, 0), (4, 1.0, 1, 0, 0), (2, 0.0, 1, 1, 1), (5, 1.0, 1, 0, 0), (4, 1.0, 1, 0, 0)],
    [(2, 0.0, 1, 1, 1), (65, 0.0, 1, 0, 1), (2, 0.0, 1, 1, 1), (4, 1.0, 1, 0, 0), (3, 1.0, 1, 0, 0), (1, 0.0, 1, 0, 1), (6, 1.0, 1, 0, 0), (5, 1.0, 1, 0, 0), (1, 0.0, 1, 0, 1), (9, 1.0, -1, 0, 0)],
    [(6, 0.0, 1, 1, 1), (100, 0.0, 1, 0, 1), (5, 0.0, 1, 1, 1), (70, 0.0, 1, 0, 1), (2, 0.0, 1, 1, 1), (60, 0.0, 1, 0, 1), (1, 0.0, 1, 0, 1)],
    [(12, 0.0, 1, 0, 1), (5, 1.0, 1, 0, 0), (4, 1.0, 1, 0, 0), (20, 0.0, 1, 0, 1)], [(7, 1.0, 1, 0, 0), (6, 1.0, 1, 0, 0), (2, 0.0, 1, 0, 1)],
    # No article element: a menu, a slogan, the text, a list of links under a heading of its own, a copyright line.
    [(1, 1.0, 0, 0, 0), (2, 1.0, 0, 0, 0), (1, 1.0, 0, 0, 0), (5, 0.0, 0, 0, 0), (1, 1.0, 0, 0, 0), (2, 1.0, 0, 0, 0), (7, 0.0, 0, 1, 1), (45, 0.0, 0, 0, 1), (80, 0.02, 0, 0, 1), (3, 0.0, 0, 0, 1), (25, 0.0, 0, 0, 1),
     (12, 0.1, 0, 0, 1), (60, 0.0, 0, 0, 1), (2, 0.0, 0, 1, 0), (6, 1.0, 0, 0, 0), (8, 1.0, 0, 0, 0), (5, 1.0, 0, 0, 0), (8, 0.0, 0, 0, 0)],
    [(4, 0.9, 0, 0, 0), (2, 1.0, 0, 0, 0), (9, 0.0, 0, 1, 1), (70, 0.0, 0, 0, 1), (1, 0.0, 0, 0, 1), (55, 0.0, 0, 0, 1), (5, 0.0, 0, 1, 1), (35, 0.0, 0, 0, 1), (28, 0.1, 0, 0, 1), (3, 1.0, 0, 0, 0), (4, 0.8, 0, 0, 0), (6, 0.0, 0, 0, 0)],
    # Short texts.
    [(1, 1.0, 0, 0, 0), (3, 0.0, 0, 1, 1), (15, 0.0, 0, 0, 1), (12, 0.0, 0, 0, 1), (18, 0.05, 0, 0, 1)],
    [(20, 0.0, 0, 0, 1)],
    [(6, 0.0, 0, 1, 1), (22, 0.0, 0, 0, 1), (4, 0.0, 0, 0, 1), (30, 0.0, 0, 0, 1), (1, 1.0, 0, 0, 0), (1, 1.0, 0, 0, 0), (3, 0.0, 0, 0, 0), (1, 1.0, 0, 0, 0)],
    [(1, 1.0, 0, 0, 0), (2, 1.0, 0, 0, 0), (40, 0.0, 0, 0, 1), (30, 0.0, 0, 0, 1), (3, 0.0, 0, 1, 0), (5, 1.0, 0, 0, 0), (6, 1.0, 0, 0, 0), (1, 0.0, 0, 1, 0), (2, 1.0, 0, 0, 0), (1, 1.0, 0, 0, 0)],
    [(2, 1.0, 0, 0, 0), (60, 0.0, 0, 0, 1), (22, 0.1, 0, 0, 1), (9, 0.0, 0, 0, 1), (33, 0.0, 0, 0, 1), (2, 0.0, 0, 1, 1), (50, 0.0, 0, 0, 1), (2, 0.0, 0, 1, 0), (1, 1.0, 0, 0, 0), (3, 1.0, 0, 0, 0), (10, 0.0, 0, 0, 0)],
    [(1, 0.0, 0, 1, 0), (4, 1.0, 0, 0, 0), (3, 1.0, 0, 0, 0), (2, 0.0, 0, 1, 0), (5, 1.0, 0, 0, 0), (18, 0.0, 0, 0, 1), (75, 0.0, 0, 0, 1), (4, 0.0, 0, 1, 1), (64, 0.0, 0, 0, 1)],
    # A page of teasers: no text of its own.
    [(2, 1.0, 0, 0, 0), (3, 1.0, 0, 0, 0), (8, 0.9, 0, 1, 0), (20, 0.6, 0, 0, 0), (7, 1.0, 0, 1, 0), (25, 0.7, 0, 0, 0), (9, 1.0, 0, 1, 0), (3, 0.5, 0, 0, 0), (2, 1.0, 0, 0, 0), (4, 0.0, 0, 0, 0), (3, 1.0, 0, 0, 0)],
    # A page that is one form as a whole.
    [(1, 1.0, -0.5, 0, 0), (2, 1.0, -0.5, 0, 0), (6, 0.0, -0.5, 1, 1), (70, 0.0, -0.5, 0, 1), (40, 0.05, -0.5, 0, 1), (55, 0.0, -0.5, 0, 1), (2, 0.0, -0.5, 0, 0), (1, 0.0, -0.5, 0, 0), (3, 1.0, -0.5, 0, 0)],
    [(2, 0.0, -0.5, 0, 0), (4, 0.0, -0.5, 0, 0), (1, 0.0, -0.5, 0, 0), (12, 0.1, -0.5, 0, 0)],
]


def rows_of_pages(pages: list[list[tuple]]) -> list[tuple]:
    """Each block's own figures, those of the block before and after it (words and link density; none: 0), and its label."""
    rows = []
    for page in pages:
        for before, b, after in zip([(0, 0.0), *page], page, [*page[1:], (0, 0.0)]):
            rows.append((*b[:4], *before[:2], *after[:2], b[4]))
    return rows


@dataclass
class Node:
    content: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A binary tree of the splits that lower Gini impurity most; ties go to the first feature, then the lowest cut."""
    node = Node(bool(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return node
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    best = gini(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if (left := gini(y[low]) + gini(y[~low])) < best:
                best, node.feature, node.cut = left, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def train(pages: list[list[tuple]] = LABELLED) -> Node:
    a = np.array(rows_of_pages(pages), dtype=float)
    return grow(a[:, :-1], a[:, -1])


def is_content(tree: Node, row: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.cut else tree.high
    return tree.content


def main_text(page: str | None, tree: Node) -> str:
    """The blocks classified as content, joined by one newline; '' for a null or empty page or one without content."""
    found = blocks(page)
    none = Block("", 0, 0.0, 0, 0)
    kept = []
    for before, b, after in zip([none, *found], found, [*found[1:], none]):
        if is_content(tree, (b.words, b.link_share, b.place, b.heading, before.words, before.link_share, after.words, after.link_share)):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page, from the whole HTML.

    Null and empty pages give ''. Null ids and URLs and repeated rows stay; unclosed and cut-off markup is read as far
    as it goes; other columns are not read; an empty table gives an empty result.
    """
    tree = train()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def one(row):
        text = main_text(row[2], tree)
        return row[0], row[1], text, len(text)

    return map_rows(rows, lambda: one, f"page_id {kind}, url string, text string, n_chars long", 256)
