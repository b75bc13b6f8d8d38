"""Main text of web pages: blocks labelled by a minimum cut.

A page is cut into blocks of text at block-level tags.  A linear classifier
over the block and the regions it stands in gives the log-odds of content; its
two costs are the capacities to the terminals.  Smoothness edges join blocks
that follow one another, the more strongly the nearer they are in the DOM, and
each block with the next one of its own parent.  The source side of a minimum
cut, found by maximum flow, is the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import lean, spare, text_parts

# --- fixed values: names of the HTML standard and common class words -------

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no markup, and elements of which nothing is shown as text.
RAW = "script style title textarea iframe noframes xmp"
UNSEEN = frozenset("noscript template svg math object audio video canvas select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag closes an open element of these names, up to one of the elements that bound it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody", "tfoot")}
BOUNDS = frozenset("ul ol dl menu table article section div main aside body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

BOILER_TAGS = frozenset("nav aside footer form menu dialog search fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOILER_WORDS = frozenset(
    """ad adbox ads advert advertisement adverts alert aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disclaimer discussion disqus footer form gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination
    popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar topbar widget""".split()
)
#: Words that may also name a wrapper of the whole page.
WRAPPER_WORDS = frozenset("aside banner header menu nav navbar notice overlay sidebar topbar widget".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
WITHOUT_MEANING = frozenset("has with no is without".split())

# --- parameters of the classifier and the cut ------------------------------

#: Log-odds of content: by region, and by features of a block.
WEIGHTS = {"boiler_tag": -14.0, "boiler_word": -11.0, "article": 6.0, "main": 5.0, "content_word": 3.0, "bias": -1.6, "log_words": 0.8, "links": -4.0, "paragraph": 1.0, "heading": 0.6, "item": -0.5, "sentence": 0.7}
#: Capacities of smoothness edges: between neighbours, more for DOM proximity (halved with every step between them), and to the next of the parent.
SMOOTH = {"adjacent": 0.3, "proximity": 1.2, "sibling": 0.4}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW.replace(' ', '|')})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?…。]['\"”»)]*$")


class Element:
    """An open or closed element, and what its place says about text below it."""

    __slots__ = ("articles", "boiler", "content", "depth", "inside", "name", "parent", "region", "unseen", "wrapper")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.articles, self.wrapper, self.region = int(name in ("article", "main")), False, (0.0, 0.0)
        self.inside = bool(parent and (parent.inside or parent.name in ("article", "main")))
        self.unseen = name in UNSEEN or bool(parent and parent.unseen)
        self.boiler, self.content = 0.0, 0.0
        roles, classes, hidden = [], [], False
        if attributes and name not in ("html", "body"):
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
                if key == "role":
                    roles += value.lower().split()
                elif key in ("class", "id"):
                    classes += [[w.lower() for w in _WORDS.findall(x)] for x in value.split()]
                else:
                    hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower()
        self.judge(roles, classes, hidden)

    def judge(self, roles: list[str], classes: list[list[str]], hidden: bool) -> None:
        if self.name in BOILER_TAGS or self.name == "header" and not self.inside or hidden or any(r in BOILER_ROLES for r in roles):
            self.boiler = WEIGHTS["boiler_tag"]
        for words in classes:
            if words and words[0] in WITHOUT_MEANING:
                continue
            bad = {w for w in words if w in BOILER_WORDS}
            good = any(w in CONTENT_WORDS for w in words)
            if bad and not (good and bad <= {"header"}):
                self.boiler = min(self.boiler, WEIGHTS["boiler_word"])
                self.wrapper |= bad <= WRAPPER_WORDS
            elif good:
                self.content = WEIGHTS["content_word"]
        self.wrapper &= self.boiler == WEIGHTS["boiler_word"]
        if self.name == "article" or "article" in roles:
            self.content = WEIGHTS["article"]
        elif self.name == "main" or "main" in roles:
            self.content = WEIGHTS["main"]


class Block:
    """Text between two block-level tags."""

    __slots__ = ("links", "parent", "text")

    def __init__(self, text: str, links: int, parent: Element):
        self.text, self.links, self.parent = text, links, parent


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order; their elements know their regions.

    End tags without an open element are ignored, elements without an end tag
    end with their parent, and a paragraph ends where the next block begins.
    """
    root = Element("html", "", None)
    at, elements, blocks, pieces = root, [root], [], []
    link, linked, last = False, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text and not at.unseen:
                blocks.append(Block(text, linked, at))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if link:
            linked += len(text)

    for m in _TOKEN.finditer(page):
        if m.start() > last:
            add(page[last : m.start()])
        last = m.end()
        name = m.group(3)
        if name is None:
            continue
        name, ends = name.lower(), m.group(2)
        if name == "a":
            link = not ends
        elif name == "br":
            add(" ")
        elif ends:
            if name in BLOCK or name in UNSEEN:
                up = at
                while up.parent and up.name != name:
                    up = up.parent
                flush()
                if up.parent:
                    at = up.parent
                link = False
        elif name in BLOCK or name in UNSEEN and name not in VOID:
            flush()
            link = False
            if name in BLOCK and at.name == "p":
                at = at.parent
            if name in CLOSES:
                up = at
                while up.parent and up.name not in BOUNDS:
                    if up.name in CLOSES[name]:
                        at = up.parent
                    up = up.parent
            if name in ("html", "body") and at is root or name in VOID:
                continue
            at = Element(name, m.group(4), at)
            elements.append(at)
    if last < len(page):
        add(page[last:])
    flush()
    set_regions(elements)
    return blocks


def set_regions(elements: Sequence[Element]) -> None:
    """Of each element, the worst and the best region that it stands in; parents come before children.

    A classed wrapper that holds all articles of the page is no region.
    """
    for e in reversed(elements[1:]):
        e.parent.articles += e.articles
    for e in elements:
        bad, good = e.parent.region if e.parent else (0.0, 0.0)
        lifted = e.wrapper and 0 < e.articles == elements[0].articles
        e.region = (bad if lifted else min(bad, e.boiler), max(good, e.content))


def log_odds(block: Block) -> float:
    """How much likelier the block is content than boilerplate, by the classifier: its worst region counts, or else the best."""
    bad, good = block.parent.region
    words, name, w = block.text.count(" ") + 1, block.parent.name, WEIGHTS
    z = w["bias"] + (bad or good) + w["log_words"] * math.log1p(min(words, 60)) + w["links"] * min(1.0, block.links / len(block.text))
    if name in HEADINGS:
        return z + w["heading"]
    z += w["paragraph"] if name in ("p", "blockquote", "pre") else w["item"] if name == "li" else 0
    return z + (w["sentence"] if _SENTENCE.search(block.text) else 0)


def steps_between(a: Element, b: Element, most: int = 64) -> int:
    """Edges of the DOM between two elements, ``most`` if there are more."""
    n = 0
    while a is not b and n < most:
        if a.depth >= b.depth:
            a, n = a.parent, n + 1
        else:
            b, n = b.parent, n + 1
    return n


def edges_of(blocks: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity)."""
    out, before = [], {}
    for j, block in enumerate(blocks):
        own = block.parent if block.parent.name not in ("p", "li", *HEADINGS) else block.parent.parent or block.parent
        if j:
            out.append((j - 1, j, SMOOTH["adjacent"] + SMOOTH["proximity"] * 0.5 ** steps_between(blocks[j - 1].parent, block.parent)))
        if (i := before.get(id(own))) is not None:
            out.append((i, j, SMOOTH["sibling"]))
        before[id(own)] = j
    return out


def source_side(odds: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """The smallest source side of a minimum cut, by maximum flow along shortest paths.

    Node i has capacity log(1 + exp(odds)) from the source and
    log(1 + exp(-odds)) to the sink; the flow straight through it leaves the
    difference, its odds, on one side.  Levels are found breadth first from all
    nodes with something left to give, and filled depth first.
    """
    n, left = len(odds), list(odds)
    near: list[list[int]] = [[] for _ in range(n)]
    ends, room = [], []
    for i, j, c in edges:
        near[i].append(len(ends))
        near[j].append(len(ends) + 1)
        ends += [j, i]
        room += [c, c]
    tiny = 1e-9

    def levels() -> tuple[list[int], bool]:
        level, reached = [-1] * n, False
        queue = deque(i for i in range(n) if left[i] > tiny)
        for i in queue:
            level[i] = 0
        while queue:
            i = queue.popleft()
            reached |= left[i] < -tiny
            for e in near[i]:
                if room[e] > tiny and level[ends[e]] < 0:
                    level[ends[e]] = level[i] + 1
                    queue.append(ends[e])
        return level, reached

    while True:
        level, reached = levels()
        if not reached:
            return [v >= 0 for v in level]
        turn = [0] * n
        for start in range(n):
            if level[start] != 0:
                continue
            path: list[int] = []
            at = start
            while left[start] > tiny:
                if left[at] < -tiny:
                    flow = min(left[start], -left[at], *(room[e] for e in path))
                    left[start] -= flow
                    left[at] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, at = [], start
                    continue
                while turn[at] < len(near[at]):
                    e = near[at][turn[at]]
                    if room[e] > tiny and level[ends[e]] == level[at] + 1:
                        break
                    turn[at] += 1
                else:
                    if not path:
                        break
                    at = ends[path.pop() ^ 1]
                    turn[at] += 1
                    continue
                path.append(e)
                at = ends[e]


def main_blocks(page: str | None) -> tuple[list[str], int]:
    """The texts of content blocks in page order, and the number of all blocks."""
    blocks = blocks_of(page or "")
    keep = source_side([log_odds(b) for b in blocks], edges_of(blocks))
    return [b.text for b, k in zip(blocks, keep, strict=True) if k], len(blocks)


@lean
def _extract(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Column 0 is the page; the others go through."""
    for batch in batches:
        at = 0
        for part in text_parts(batch, 0):
            found = [main_blocks(p) for p in part]
            kept = [c.slice(at, len(part)) for c in batch.columns[1:]]
            new = [pa.array(["\n\n".join(t) for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=names)
            at += len(part)


def extract(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and (text, n_main, n_blocks): main text, and how many blocks it is of how many.

    Blocks have character references decoded and white space made one space
    (a line break counts as such); two line feeds join them.  A null or empty
    page, or one without content, has an empty text.  Whole pages are parsed,
    each by itself: no row is shuffled, and pages that repeat, tie or share an
    id give a row each.  Columns beyond ``keep`` are not read; one of ``keep``
    may not be named like a new one.
    """
    names = [*keep, "text", "n_main", "n_blocks"]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"columns to keep clash with new ones: {list(keep)}")
    rows = pages.select(F.col(html_col).cast("string").alias(spare("page", pages)), *keep)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), "text string", "n_main int", "n_blocks int"])
    return rows.mapInArrow(partial(_extract, names=names), shape)

