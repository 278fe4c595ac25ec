"""HTML extraction by the maximum-scoring subsequence (operator 6).

A page is a sequence of text runs and tags.  Text scores by its words, tags against it, with weights
learnt from pages whose own mark-up says what the article is; one linear scan finds the contiguous
region of the highest sum.  The region is then widened to the element that holds it, and elements in
it that are page furniture go.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the weights are learnt from at most: those with the smallest hashes of their ids.
MAX_PAGES = 200
#: Characters of a page from which nothing is learnt, so that what comes to the driver is bounded; its text is extracted all the same.
MAX_LEARNT = 200_000
#: Weight of a tag and of a word of a context that no labelled page had.
UNSEEN_TAG, UNSEEN_WORD = -1.0, 0.4

# Element names of the HTML standard, and words that name page furniture.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "canvas", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "body", "center", "div", "html", "main", "section", "table", "tbody"}
FURNITURE = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "input", "label", "fieldset"}
FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disclaimer", "footer", "form", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager",
    "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "responses", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that only say where a part of a page is, or what it is made of.
LAYOUT_WORDS = {
    "reader", "user", "site", "page", "post", "posts", "article", "articles", "main", "top", "bottom", "left", "right", "header", "head", "list", "area", "box", "block", "section",
    "wrapper", "wrap", "container", "inner", "outer", "content", "item", "items", "group", "panel", "bar", "row", "col", "column", "primary", "secondary", "global", "mobile",
    "sticky", "fixed", "links", "link", "button", "buttons", "thread", "count", "title",
}
#: Elements that are text themselves: what their ids and classes are called does not make them furniture.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "summary", "code", "em", "strong", "b", "i", "q", "mark"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[a-zA-Z/!?](?>"[^"]*"|'[^']*'|[^"'>])*+>|<[a-zA-Z/!?][^>]*>""", re.DOTALL)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_WHITE = re.compile(r"\s+")


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a start tag, names and values in lower case; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(tag, _NAME.match(tag).end()):
        found.setdefault(name.lower(), value.strip("\"'").lower())
    return found


def names_furniture(names: str) -> bool:
    """Whether one of the names of a class or id stands for page furniture: a word for it, and no other words but those of layout."""
    return any((words := {w for w in _SPLIT.split(name) if w and not w.isdigit()}) & FURNITURE_WORDS and words <= FURNITURE_WORDS | LAYOUT_WORDS for name in names.split())


class Node:
    """An element: its name, its place among the items, whether it is page furniture, how many of it and those above are, and whether one above is content mark-up."""

    __slots__ = ("name", "parent", "start", "end", "furniture", "depth", "vetoes", "marked")

    def __init__(self, name: str, parent: Node | None, start: int, furniture: bool):
        self.name, self.parent, self.start, self.end, self.furniture = name, parent, start, -1, furniture
        self.depth = parent.depth + 1 if parent else 0
        self.vetoes = (parent.vetoes if parent else 0) + furniture
        self.marked = name in ("article", "main", "section") or bool(parent and parent.marked)


def parse(page: str) -> tuple[list[tuple[str, str, Node]], Node]:
    """Items ``kind, value, element`` in page order; kind is 't' for text, otherwise the tag with its sign."""
    root = node = Node("#page", None, 0, False)
    items: list[tuple[str, str, Node]] = []
    opened: Counter[str] = Counter()
    at, low, size = 0, None, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if (m.start() if m else size) > at:
            items.append(("t", page[at : m.start() if m else size], node))
        if not m:
            break
        at = m.end()
        name = _NAME.match(m[0])
        if not name:
            continue  # a comment, a doctype or a processing instruction
        tag = name[1].lower()
        if m[0][1] == "/":
            if opened[tag]:  # else it closes nothing
                up = node
                while up.name != tag:
                    up = up.parent
                items.append(("/" + tag, "", up))
                while node is not up.parent:
                    opened[node.name] -= 1
                    node.end = len(items)
                    node = node.parent
            continue
        if tag in RAW and tag != "head":  # its content is no mark-up
            low = page.lower() if low is None else low
            close = low.find(f"</{tag}", at) if len(low) == size else re.compile(f"</{tag}", re.I).search(page, at)
            close = close if isinstance(close, int) else close.start() if close else -1
            stop = page.find(">", close) if close >= 0 else -1
            at = stop + 1 if stop >= 0 else size
            continue
        while node.name in CLOSES.get(tag, ()) or node.name == "p" and tag in BLOCKS:
            opened[node.name] -= 1
            node.end = len(items)
            node = node.parent
        marks = attributes(m[0])
        named = tag not in TEXTUAL and (names_furniture(marks.get("class", "")) or names_furniture(marks.get("id", "")))
        furniture = tag in FURNITURE or tag == "head" or named or marks.get("role") in FURNITURE_ROLES or "hidden" in marks or marks.get("aria-hidden") == "true"
        if tag == "header":
            furniture = furniture or not node.marked
        if tag in ("body", "html", "article", "main"):
            furniture = False
        items.append((tag, "!" if furniture else "", node))
        if tag not in VOID and not m[0].endswith("/>"):
            node = Node(tag, node, len(items) - 1, furniture)
            opened[tag] += 1
    while node:
        node.end = len(items) if node.end < 0 else node.end
        node = node.parent
    return items, root


def context(item: tuple[str, str, Node]) -> str:
    """What an item's weight depends on: a tag's name, sign and furniture; for text, its element and furniture above."""
    kind, value, node = item
    if kind != "t":
        return f"{kind}{value}"
    return f"t:{node.name}:{node.vetoes > 0}"


def learn(pages: list[str]) -> dict[str, float]:
    """Log-odds weights of contexts, from pages in which an ``article`` or ``main`` element marks the content."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        items, _ = parse(page)
        marked = [x[2] for x in items if x[2].name in ("article", "main")]
        if not marked:
            continue
        top = min(marked, key=lambda n: n.depth)
        for i, x in enumerate(items):
            n = len(x[1].split()) if x[0] == "t" else 1
            (inside if top.start < i < top.end - 1 or x[0] == "t" and top.start < i < top.end else outside)[context(x)] += n
    words_in, words_out = (sum(v for k, v in c.items() if k[:2] == "t:") or 1 for c in (inside, outside))
    weights = {}
    for k in inside.keys() | outside.keys():
        odds = math.log((inside[k] + 0.5) / (outside[k] + 0.5))
        if k[:2] == "t:":
            weights[k] = max(-1.0, min(1.0, odds - 0.5 * math.log(words_in / words_out)))
        else:  # tags count against a region, those never seen inside one most
            weights[k] = min(-0.05, max(-12.0, odds - 1.0))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run of the highest positive sum; the first of equal ones; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The page's article: its blocks, white space in each made one space, joined by line ends."""
    if not page:
        return ""
    items, _ = parse(page)
    counts = [len(x[1].split()) if x[0] == "t" else 0 for x in items]
    scores = []
    for x, n in zip(items, counts, strict=True):
        w = weights.get(context(x))
        scores.append(n * (UNSEEN_WORD if w is None else w) if x[0] == "t" else UNSEEN_TAG if w is None else w)
    lo, hi = best_region(scores)
    if lo == hi:
        return ""
    told = [i for i in range(lo, hi) if counts[i] and scores[i] > 0]
    node = items[told[0]][2] if told else None  # the deepest element over the region's text
    while node and node.parent and not (node.start <= told[0] and told[-1] < node.end):
        node = node.parent
    up = node
    while up and up.name not in ("article", "main"):
        up = up.parent
    node = up or node
    while node and node.name not in CONTAINERS and node.parent:
        node = node.parent
    if node and node.name not in ("body", "html", "#page"):
        lo, hi = node.start, node.end
    blocks: list[list[str]] = [[]]
    for i in range(lo, hi):
        kind, value, at = items[i]
        if kind != "t":
            if kind.lstrip("/") in BLOCKS:
                blocks.append([])
            elif kind == "br":
                blocks[-1].append(" ")
            continue
        if at.vetoes == (node.vetoes if node else 0):
            blocks[-1].append(value)
    lines = (_WHITE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def labelled_pages(pages: DataFrame, limit: int = MAX_PAGES, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """Pages with content mark-up, at most ``limit``, chosen by a hash of their ids; only these reach the driver."""
    marked = pages.where((F.length(html_col) < MAX_LEARNT) & F.col(html_col).rlike("(?i)<(article|main)[ >]"))
    ids = marked.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(limit)
    chosen = marked.join(F.broadcast(ids), id_col).select(id_col, html_col).orderBy(F.xxhash64(id_col), html_col).limit(limit)
    return [r[1] for r in chosen.collect()]


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null or empty html gives the empty text.

    Weights are learnt from ``labelled_pages`` unless given.  Repeated rows stay, other columns are not looked at.
    """
    weights = learn(labelled_pages(pages, MAX_PAGES, id_col, html_col)) if weights is None else weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(work, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
