"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text that no block-level tag interrupts, with the element that
holds them. A linear classifier gives each block two costs, that of calling it content and that of
calling it boilerplate, from the tags, classes and roles around it, its share of link text, its
length and its sentence ends. The blocks are the nodes of a flow network: the cost of calling a block
boilerplate is the capacity from the source, the cost of calling it content that to the sink.
Neighbours in page order, and next blocks of the same element, are joined by edges whose capacity
falls with their distance in the tree. A maximum flow then gives the cheapest labelling; where two
labellings cost the same, a block is content.

There are no labelled pages to learn from, so the classifier's weights are fixed parameters.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import packed, sliced_udf

# Weights of the classifier, in one unit with the capacities of the edges.
CONTENT_PLACE, BOILERPLATE_PLACE, WEAK_PLACE = 300, 900, 200
LINKS, WORD, MOST_WORDS, SENTENCE, LIST_ITEM, PHRASE, PLAIN = 400, 5, 40, 40, 30, 200, 60
#: Capacities of edges at distance 0: neighbours in page order, next blocks of one element.
NEIGHBOUR, SAME_PARENT = 120, 60
#: Steps in the tree beyond which two blocks count as far apart.
FAR = 12

# Elements of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = set("head template noscript svg math object audio video canvas datalist".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - set("body button html label legend option optgroup select tbody tfoot thead tr caption".split())
#: Start tags that end an open element of their own kind, and what bounds the search for it.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead")}
BOUNDS = set("ul ol menu dir dl table select body html article aside section nav main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Places of boilerplate and of content, by tag, role and words of class and id.
BOILERPLATE_TAGS = set("nav footer aside menu dialog button label legend select option optgroup search".split())
CONTENT_TAGS = {"article", "main"}
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT_ROLES = {"main", "article"}
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adbox|adslot|adsense|nav|navbar|navigation|menu|footer|foot|header|masthead|banner|notice|notification|alert|share|sharing|social|related|recommended|widget|login|signup|subscribe|search|consent|gdpr|copyright|legal|pager|reply|replies|respond|discussion|hidden|teaser|toc)(?:$|[^a-z])"
    r"|comment|sidebar|side-bar|cookie|newsletter|advert|breadcrumb|pagination|disqus|sponsor|promo|popup|pop-up|modal|toolbar"
)
CONTENT_NAMES = re.compile(r"(?:^|[^a-z])(?:article|content|entry|post|story|main|text|body)(?:$|[^a-z])")
NOT_SO = re.compile(r"(?:has|with|no|without)[-_]?[a-z-]+")
PHRASES = re.compile(r"^\s*(?:©|\(c\) )|all rights reserved|we use cookies|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|sign up for|log ?in to|subscribe (?:to|now)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE_END = re.compile(r"[.!?…。！？;:][\"'”’»)\]]*$")

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LOOKED_AT = ("class", "id", "role", "hidden", "style", "aria-hidden")


@dataclass(slots=True)
class Element:
    """An open block-level element and what its place says of the text in it."""

    tag: str
    parent: "Element | None"
    depth: int
    content: int = 0
    boilerplate: int = 0
    unseen: bool = False


@dataclass(slots=True)
class Block:
    """A run of text: its words, the letters of them inside links, and the element that holds it."""

    element: Element
    text: str
    letters: int
    linked: int


def _place(tag: str, attributes: str, parent: Element | None) -> tuple[int, int, bool]:
    """Content and boilerplate evidence of an element and whether it is not displayed, with what holds it."""
    content, boilerplate, unseen = (parent.content, parent.boilerplate, parent.unseen) if parent else (0, 0, False)
    inside = content >= CONTENT_PLACE
    if tag in CONTENT_TAGS:
        content = max(content, CONTENT_PLACE)
    if tag in BOILERPLATE_TAGS or (tag == "header" and not inside):
        boilerplate = max(boilerplate, BOILERPLATE_PLACE)
    if tag in ("form", "fieldset"):
        boilerplate = max(boilerplate, WEAK_PLACE)
    if not attributes or attributes.isspace():
        return content, boilerplate, unseen or tag in UNSEEN
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if (name := name.lower()) in _LOOKED_AT:
            found.setdefault(name, html.unescape(a or b or c))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        unseen = True
    roles = set(found.get("role", "").lower().split())
    if roles & CONTENT_ROLES:
        content = max(content, CONTENT_PLACE)
    if roles & BOILERPLATE_ROLES:
        boilerplate = max(boilerplate, BOILERPLATE_PLACE)
    names = NOT_SO.sub(" ", _CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").lower())
    if tag not in ("html", "body") and not names.isspace():
        fits = CONTENT_NAMES.search(names)
        if BOILERPLATE_NAMES.search(names):
            # The header of an article is of the article; a comment in an article is a comment.
            boilerplate = max(boilerplate, WEAK_PLACE if inside and re.search(r"header|text|title", names) and not re.search("comment", names) else BOILERPLATE_PLACE)
        elif fits:
            content = max(content, WEAK_PLACE)
    return content, boilerplate, unseen or tag in UNSEEN


@dataclass(slots=True)
class Reader:
    """Blocks of one page, in page order."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    open: dict[str, int] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    link_depth: int = -1

    def read(self, page: str) -> list[Block]:
        self._push("html", "")
        at, last = 0, page.rfind(">") + 1  # no tag ends after it
        while found := _TOKEN.search(page, at, last):
            self._text(page[at : found.start()])
            at = found.end()
            if found[0].startswith("<!--") and not found[0].endswith(("-->", "--!>")):
                at = len(page)  # a comment that never ends
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            elif tag in RAW and tag not in self.open:
                # What is inside is not marked up; without an end tag it is the rest of the page.
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
                last = max(last, at)
            else:
                self._start(tag, attributes)
        self._text(page[at:].partition("<!--")[0])
        self._flush()
        return self.blocks

    def _text(self, raw: str) -> None:
        if raw and not self.stack[-1].unseen:
            text = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.link_depth >= 0:
                self.linked += len("".join(text.split()))

    def _flush(self) -> None:
        """End the block that is being read."""
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                self.blocks.append(Block(self.stack[-1], " ".join(words), sum(map(len, words)), self.linked))
            self.pieces, self.linked = [], 0

    def _push(self, tag: str, attributes: str) -> None:
        parent = self.stack[-1] if self.stack else None
        self.stack.append(Element(tag, parent, len(self.stack), *_place(tag, attributes, parent)))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        """Close all elements from this depth on, but never the root."""
        self._flush()
        while len(self.stack) > max(1, depth):
            self.open[self.stack.pop().tag] -= 1
        if self.link_depth > len(self.stack):
            self.link_depth = -1

    def _close_open(self, kinds: tuple[str, ...], bounds: set[str]) -> None:
        if any(self.open.get(k) for k in kinds):
            for element in reversed(self.stack):
                if element.tag in kinds:
                    return self._pop_to(element.depth)
                if element.tag in bounds:
                    return None
        return None

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link_depth = len(self.stack)
        elif tag in ("br", "td", "th"):
            self.pieces.append(" ")
        elif tag in BLOCK or tag in UNSEEN:
            if tag not in UNSEEN:
                self._flush()
            if tag in ("html", "body") and self.open.get(tag):
                return
            if tag == "body":
                self._pop_to(1)  # an open head ends here
            if tag in CLOSES_P:
                self._close_open(("p",), BOUNDS - {"article", "aside", "section", "nav", "main", "ul", "ol", "menu", "dir", "dl"})
            if tag in SIBLINGS:
                self._close_open(SIBLINGS[tag], BOUNDS)
            if tag not in VOID:
                self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = -1
        elif tag in ("td", "th"):
            self.pieces.append(" ")
        elif (tag in BLOCK or tag in UNSEEN) and tag not in ("html", "body") and self.open.get(tag):
            if tag in UNSEEN and self.stack[-1].tag == tag:
                self.open[self.stack.pop().tag] -= 1  # not displayed: it does not part the text around it
                return
            self._pop_to(next(e.depth for e in reversed(self.stack) if e.tag == tag))


def costs(block: Block) -> tuple[int, int]:
    """What it costs to call a block boilerplate, and to call it content."""
    place, words = block.element, block.text.count(" ") + 1
    share = block.linked / max(1, block.letters)
    sentence = bool(_SENTENCE_END.search(block.text))
    boilerplate = place.content + WORD * min(words, MOST_WORDS) + SENTENCE * sentence + (SENTENCE if place.tag in HEADINGS else 0) + PLAIN
    content = place.boilerplate + round(LINKS * share) + (LIST_ITEM if place.tag == "li" else 0)
    if words < MOST_WORDS and PHRASES.search(block.text):
        content += PHRASE
    return boilerplate, content


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Network:
    """A flow network of blocks with a source and a sink; capacities are integers."""

    def __init__(self, to_source: list[int], to_sink: list[int]):
        # What goes straight from the source over a block to the sink is spent at once.
        self.excess = [a - min(a, b) for a, b in zip(to_source, to_sink)]
        self.lack = [b - min(a, b) for a, b in zip(to_source, to_sink)]
        self.edges: list[list[int]] = [[] for _ in to_source]
        self.head: list[int] = []
        self.room: list[int] = []

    def join(self, a: int, b: int, capacity: int) -> None:
        """An edge of this capacity both ways."""
        for x, y in ((a, b), (b, a)):
            self.edges[x].append(len(self.head))
            self.head.append(y)
            self.room.append(capacity)

    def _levels(self) -> list[int]:
        """Steps from each block to the nearest one with room to the sink, -1 if there is no way."""
        level = [0 if x else -1 for x in self.lack]
        queue = deque(k for k, x in enumerate(self.lack) if x)
        while queue:
            b = queue.popleft()
            for e in self.edges[b]:
                a = self.head[e]
                if level[a] < 0 and self.room[e ^ 1]:
                    level[a] = level[b] + 1
                    queue.append(a)
        return level

    def saturate(self) -> list[int]:
        """Push flow along shortest ways until none is left; the levels of the rest then part the labels."""
        while True:
            level = self._levels()
            if not any(x and level[k] >= 0 for k, x in enumerate(self.excess)):
                return level
            next_edge = [0] * len(self.edges)
            for start, x in enumerate(self.excess):
                if x and level[start] >= 0:
                    self._push_from(start, level, next_edge)

    def _push_from(self, start: int, level: list[int], next_edge: list[int]) -> None:
        path: list[int] = []
        at = start
        while self.excess[start]:
            if level[at] == 0 and self.lack[at]:
                amount = min([self.excess[start], self.lack[at], *[self.room[e] for e in path]])
                self.excess[start] -= amount
                self.lack[at] -= amount
                for e in path:
                    self.room[e] -= amount
                    self.room[e ^ 1] += amount
                path, at = [], start
                continue
            while next_edge[at] < len(self.edges[at]):
                e = self.edges[at][next_edge[at]]
                if self.room[e] and level[self.head[e]] == level[at] - 1:
                    break
                next_edge[at] += 1
            if next_edge[at] < len(self.edges[at]):
                path.append(e)
                at = self.head[e]
            elif path:
                at = self.head[path.pop() ^ 1]
                next_edge[at] += 1
            else:
                return


def network(blocks: list[Block]) -> Network:
    found = [costs(b) for b in blocks]
    flow = Network([a for a, _ in found], [b for _, b in found])
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        if k and (capacity := NEIGHBOUR // (1 + distance(blocks[k - 1].element, block.element))):
            flow.join(k - 1, k, capacity)
        up = block.element.parent or block.element
        before = last.get(id(up))
        if before is not None and before < k - 1:
            flow.join(before, k, SAME_PARENT)
        last[id(up)] = k
    return flow


def labelled(page: str | None) -> list[tuple[str, bool]]:
    """The blocks of a page and whether each is content."""
    blocks = Reader().read(page or "")
    level = network(blocks).saturate()
    # Content is whatever the sink can no longer be reached from.
    return [(b.text, x < 0) for b, x in zip(blocks, level)]


_KIND = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("is_content", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("is_content", pa.bool_())]))


def _labelled(column: pa.Array) -> pa.Array:
    return pa.array([[{"text": t, "is_content": c} for t, c in labelled(page)] for page in column.to_pylist()], _ARROW)


def extract(pages: DataFrame, body: str = "html") -> DataFrame:
    """All columns of each page in `row`, its `blocks` (text, is_content) in page order and its main `text`.

    White space in a block becomes one space; the text is the content blocks, one a line. Null and
    empty pages, and pages without content, have no text ('') and null never occurs. Rows that
    repeat are each extracted. An empty table gives an empty result.
    """
    cut = packed(pages, _body=body).select("row", sliced_udf(_labelled, _KIND)(F.coalesce("_body", F.lit(""))).alias("blocks"))
    content = F.transform(F.filter("blocks", lambda b: b["is_content"]), lambda b: b["text"])
    return cut.select("row", "blocks", F.array_join(content, "\n").alias("text"))
