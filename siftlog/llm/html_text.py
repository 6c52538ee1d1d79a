"""Main text of web pages by composite text density.

A page becomes a tree of elements. For each node the density is its characters per tag, adjusted by how much of its
text and of the whole body is in links (Sun, Song and Liao 2011); a node's sum is that of the densities of its children
and of the text directly in it. The node with the largest sum is the article's core; an ``article`` element around it
is kept whole. The least density on the path from the core to the body is the threshold, or half the core's mean part
where that is less, as size alone raises the density of pages with few links. On the way up to the body, siblings that reach
the threshold belong to the article, with what lies between them and the headings and paragraphs next to them. The
blocks of all this, without elements that never belong to an article, are the text: those of some tags, and those with
a class, id or role that is made up of words such as ``ad``, ``comments`` or ``sidebar`` and of plain ones such as ``list``
(so ``share-buttons`` is one, ``market-share`` isn't). Such names don't overrule the text: ``article`` and ``main`` never go
by them, nor does what holds a page's only one, nor an element with over three times the text that isn't marked; marks of
readers' comments stay, but for what holds the only ``main`` or ``h1``. Pages are read in time that grows with their length, whatever their tags.

Edge cases: null and empty pages give an empty text, as do pages without text; unclosed and wrongly nested tags are
closed where the next tag implies it; text outside any element counts as the body's; of equal sums the first node in
page order wins; repeated pages are treated alike; long pages are read whole; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^<>]*+>|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
SPACES = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: What holds text without tags; outside, too.
TEXT_ONLY = frozenset(("title", "textarea"))
OUTSIDE = frozenset("nav aside footer form menu button select dialog head object canvas".split())
#: Words of a class, id or role that mark what isn't article, if nothing but such words and those after them make up the name.
MARKS = frozenset(
    "ad ads adv advert advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Those of them that mark readers' comments.
SAID = frozenset("comment comments discussion disqus replies reply respond".split())
PLAIN = frozenset(
    "above area article articles bar before below block body bottom box btn button buttons center col column container content count default end entry expanded extra feed fixed form full global grid group hidden holder icons id inline inner item items js large layout left level line link links list main menu middle mobile module open outer page panel parent post posts primary region right row secondary section semantic side single site slot small static sticky story tag tags text thread title top under unit view visible wide wrap wrapper zone".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements that never go by their names.
NEVER = frozenset(("article", "main", "body"))
#: A marked element with so many times the text that no mark is on is the article all the same.
MOST = 3
#: Elements that hold an article for sure, within each kind of mark.
SURE = {1: frozenset(("article", "main")), 2: frozenset(("main", "h1"))}
LEAST = 250  # characters; notices may be longer than a very short article
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What an opening tag closes, up to the border named after it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def marked(names: str, within: bool) -> int:
    """Whether one of the names of a class, id or role says that an element isn't article: 2 for readers' comments, 1 for other marks."""
    most = 0
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if "header" in words and not within and all(w in MARKS or w in PLAIN or w == "header" for w in words):
            most = max(most, 1)
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in PLAIN for w in words):
            most = max(most, 1 if SAID.isdisjoint(words) else 2)
    return most


class Node:
    __slots__ = ("tag", "parent", "children", "outside", "within", "link", "href", "chars", "tags", "link_chars", "link_tags", "density", "mark")

    def __init__(self, tag: str, parent: "Node | None", outside: bool):
        self.tag, self.parent, self.outside = tag, parent, outside
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.children: list = []
        self.href: str | None = None
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.mark = 0  # what its names say


class Open:
    """The open elements, and for each tag how deep they are, so that no end tag has to look through them all."""

    def __init__(self, root: Node):
        self.stack, self.depths, self.blocks = [root], {}, []

    def last(self, tag: str) -> int:
        """How deep the innermost open element of this tag is; 0 if none is open."""
        depths = self.depths.get(tag)
        return depths[-1] if depths else 0

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all within."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def end(self, tag: str) -> bool:
        depth = self.last(tag)
        if depth and (tag in BLOCKS or not self.blocks or self.blocks[-1] < depth):  # an inline end tag doesn't close blocks
            self.close(depth)
            return True
        return False

    def begin(self, tag: str) -> None:
        """Close what a new element of this tag closes."""
        if tag in ENDS_P and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in CLOSES:
            closed, border = CLOSES[tag]
            limit = max(map(self.last, border))
            inside = [d[bisect_right(d, limit)] for d in map(self.depths.get, closed) if d and d[-1] > limit]
            if inside:
                self.close(min(inside))


def parse(page: str, whole: bool = False) -> Node:
    """The page's tree: children are nodes and strings. Comments, scripts, styles and the like are left out.

    ``whole``: nothing is asked about what is outside the article, so names aren't read.
    """
    root = Node("body", None, False)
    open_ = Open(root)
    for m in TOKEN.finditer(page):
        raw, closing, tag, attributes = m.group(1), m.group(3), m.group(4), m.group(5)
        now = open_.stack[-1]
        if tag is None:
            piece = m.group()
            if raw is not None and raw.lower() in TEXT_ONLY:
                node = Node(raw.lower(), now, True)
                node.children.append(html.unescape(m.group(2)))
                now.children.append(node)
            elif raw is None and not piece.startswith(("<!", "<?")):
                now.children.append(html.unescape(piece))
            continue
        tag = tag.lower()
        if tag in ("html", "body"):
            continue
        if closing:
            if not open_.end(tag) and tag in ("p", "br"):
                now.children.append(Node("br", now, now.outside))
            continue
        open_.begin(tag)
        now = open_.stack[-1]
        # A header belongs to what it stands in: to an article with its heading, or else to the page.
        outside = now.outside or tag in OUTSIDE or (tag == "header" and not now.within)
        node = Node(tag, now, outside)
        if attributes and not (outside or whole or tag in NEVER):
            node.mark = max((marked(name, now.within) for g in NAMES.findall(attributes) for name in g if name), default=0)
        if tag == "a" and (h := HREF.search(attributes)):
            node.href = html.unescape(h.group(1) or h.group(2) or h.group(3) or "")
        now.children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            open_.push(node)
    if not whole:
        _settle(root)
    return root


def _settle(root: Node) -> None:
    """Which marked elements are outside: those that neither hold the page's only article nor, but for comments, most of
    its text. An article is what ``article`` or ``main`` holds, within marks of comments what ``main`` or an ``h1`` does."""
    nodes = _order(root)
    if not any(node.mark for node in nodes):
        return
    told: dict[Node, tuple[int, int, int, int]] = {}
    for node in nodes[::-1]:
        # Characters that aren't in links, in all and outside marked elements; the kinds of mark (bits 1 and 2) that tags
        # in it overrule, likewise.
        plain = free = 0
        holds = clear = 0 if node.outside else (1 if node.tag in SURE[1] else 0) | (2 if node.tag in SURE[2] else 0)
        for c in node.children:
            if isinstance(c, str):
                n = 0 if node.outside or node.link else len(c.strip())
                plain, free = plain + n, free + n
            else:
                p, f, h, k = told[c]
                plain, free, holds, clear = plain + p, free + f, holds | h, clear | k
        told[node] = (plain, 0, holds, 0) if node.mark else (plain, free, holds, clear)
    _, rest, _, clear = told[root]
    for node in nodes:
        plain, _, holds, _ = told[node]
        overruled = node.mark & holds & ~clear or (node.mark == 1 and plain > max(MOST * rest, LEAST))
        node.outside = node.outside or (node.mark > 0 and not overruled) or (node.parent is not None and node.parent.outside)


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children[::-1] if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """All nodes in page order, with their counts and densities."""
    nodes = _order(root)
    for node in nodes[::-1]:
        for c in node.children:
            if isinstance(c, str):
                n = len(SPACES.sub(" ", c).strip())
                node.chars += n
                node.link_chars += n * node.link
            elif not c.outside:
                node.chars, node.tags = node.chars + c.chars, node.tags + c.tags + 1
                node.link_chars, node.link_tags = node.link_chars + c.link_chars, node.link_tags + c.link_tags + (c.tag == "a")
    for node in nodes:
        if not node.outside:
            node.density = _density(root, node.chars, node.tags, node.link_chars, node.link_tags)
    return nodes


def _density(root: Node, c: int, t: int, link_chars: int, link_tags: int) -> float:
    if not c:
        return 0.0
    t, lc, lt = max(t, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(c / max(c - link_chars, 1) * link_chars + root.link_chars / max(root.chars, 1) * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1.0)


def _parts(root: Node, node: Node) -> list[float]:
    """The densities of a node's children and of each run of text directly in it, without those of 0."""
    out, run = [], 0
    for c in [*node.children, None]:
        if isinstance(c, str):
            run += len(SPACES.sub(" ", c).strip())
        else:
            out += [_density(root, run, 1, run * node.link, 0), c.density if c is not None and not c.outside else 0.0]
            run = 0
    return [d for d in out if d > 0]


def article(root: Node) -> Node:
    """The node with the largest sum, the first of equal ones; the root if no text has a density."""
    return max((n for n in measure(root) if not n.outside), key=lambda n: sum(_parts(root, n)))


def content(root: Node) -> Node:
    """A node with all that belongs to the article."""
    top = at = article(root)
    parts, path = _parts(root, top), []
    while at is not None:
        path.append(at)
        at = at.parent
    if not parts:
        return root
    threshold = min(*(n.density for n in path), sum(parts) / len(parts) / 2)
    whole = max((i for i, n in enumerate(path) if n.tag == "article"), default=0)
    kept = path[whole]
    for at, above in zip(path[whole:], path[whole + 1 :], strict=False):
        all_ = above.children
        dense = [i for i, c in enumerate(all_) if c is at or (isinstance(c, Node) and not c.outside and c.density >= threshold)]
        if len(dense) > 1:
            first, last = dense[0], dense[-1] + 1
            while first > 0 and _beside(all_[first - 1]):
                first -= 1
            while last < len(all_) and _beside(all_[last]):
                last += 1
            kept, below = Node(above.tag, None, False), kept
            kept.children = [below if c is at else c for c in all_[first:last]]
    return kept


def _beside(c: "Node | str") -> bool:
    """Whether ``c`` goes with the article's part next to it: a heading, a paragraph, or nothing."""
    if isinstance(c, str):
        return not c.strip()
    return c.outside or c.tag in HEADINGS or (c.tag == "p" and c.density > 0)


def blocks(top: Node) -> list[str]:
    """The text of each block below ``top`` in page order, white space as one space."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if text := SPACES.sub(" ", "".join(part)).strip():
            out.append(text)
        part.clear()

    todo: list = [top]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            part.append(c)
        elif not c.outside:
            if c.tag == "br":
                part.append(" ")
            block = c.tag in BLOCKS
            if block:
                flush()
                todo.append(None)
            todo += c.children[::-1]
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(content(parse(page)))) if page else ""


def all_text(page: str | None) -> tuple[str, list[str], str]:
    """The text of a whole page, where its links lead, and its title; for archives."""
    if not page:
        return "", [], ""
    root = parse(page, whole=True)
    nodes = _order(root)
    links = [n.href for n in nodes if n.href is not None]
    for node in nodes:
        node.outside = False
    title = next((n for n in nodes if n.tag == "title"), None)
    return "\n".join(blocks(root)), links, " ".join(blocks(title)) if title else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
