"""Main text of web pages by minimum cut.

A page is read into blocks of text.  A linear classifier gives each block a log-odds of being content; its size becomes
a capacity to the source (content) or the sink (boilerplate).  Neighbours in page order are joined by smoothness edges,
and every block is joined to its container in the document tree, containers to theirs, so that blocks near each other
in the tree prefer one label.  The minimum cut separates content from boilerplate.  A page's graph has as many nodes
and edges as the page has tags; pages are independent of each other.

Cases: a null or empty page, or one without text, gives an empty text.  Unclosed and misplaced tags are closed as
browsers do for paragraphs, list items and cells; a cut-off page is read to its end.  Repeated rows give the same text.
Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendaflux.llm.common import text_of

# Tag names of HTML, and words that sites use for the parts of a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("head title script style noscript template svg math select option button textarea iframe object canvas audio video "
                        "datalist map".split())
HEAD_TAGS = frozenset("title base link meta style script noscript template".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
BOILERPLATE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|comments?|commentlist|disqus|"
    r"replies|respond|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|copyright|masthead|topbar|toolbar|share|sharing|social|"
    r"related|recommend\w*|subscribe|subscription|newsletter|popup|modal|overlay|widget|login|signup|search|skip|pagination|pager|tags|"
    r"contentinfo|complementary)(?=$|[\s_-])", re.I)
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|text|body|articlebody)(?=$|[\s_-])", re.I)
HEADER_WORDS = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
# class names that begin so tell of the layout around a part, not of the part
MODIFIERS = re.compile(r"(?:no|not|has|have|with|without|is|hide|show|toggle)[_-]", re.I)
#: Elements that hold a whole page or its article: their class names say nothing about what is inside.
WHOLE_TAGS = frozenset("html body main article".split())

#: Weights of the classifier, in log-odds.
W = {"bias": -0.8, "boilerplate": -8.0, "hinted": -7.0, "article": 3.0, "content": 1.2, "paragraph": 1.0, "heading": 0.6, "item": -0.6,
     "length": 1.1, "sentence": 0.6, "links": -4.0, "sign": -2.5}
#: Capacities of smoothness edges: neighbours with and without the same container, block and container, containers.
NEAR, FAR, INSIDE, NESTED = 0.5, 0.15, 0.3, 0.15


class Blocks(HTMLParser):
    """Blocks of a page: ``(text, container, kind, link characters, boilerplate, hinted, article, content)``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple] = [("", 0, False, False, False, False, False, "")]  # tag, container, silent, the last four of a block, kind
        self.places: dict[str, list[int]] = defaultdict(list)  # where each tag is open, so that no tag searches the stack
        self.open_blocks: list[int] = []
        self.parents = [-1]
        self.blocks: list[tuple] = []
        self.parts: list[str] = []
        self.linked = 0
        self.kind = ""
        self.anchors = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, container, _, *flags, _ = self.stack[-1]
            self.blocks.append((text, container, self.kind, self.linked, *flags))
        self.parts.clear()
        self.linked = 0

    def pop_to(self, depth: int) -> None:
        if any(x[0] in BLOCK_TAGS for x in self.stack[depth:]):
            self.flush()
        for x in self.stack[depth:]:
            self.places[x[0]].pop()
        while self.open_blocks and self.open_blocks[-1] >= depth:
            self.open_blocks.pop()
        del self.stack[depth:]
        self.anchors, self.kind = len(self.places["a"]), self.stack[-1][-1]

    def last(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open one of the tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close_open(self, tags: set[str], scope: set[str]) -> None:
        depth = self.last(tags)
        if depth > self.last(scope - tags):
            self.pop_to(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID_TAGS:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag not in HEAD_TAGS and tag != "head" and self.places["head"]:
            self.pop_to(self.places["head"][0])
        block = tag in BLOCK_TAGS
        if block:
            self.close_open({"p"}, {"article", "section", "div", "td", "th", "body", "button"})
            if tag in CLOSED_BY:
                self.close_open(CLOSED_BY[tag], SCOPE[tag])
            self.flush()
        elif tag == "option":
            self.close_open({"option"}, {"select"})
        _, container, silent, bad, hinted, article, content, _ = self.stack[-1]
        if block:
            self.parents.append(container)
            container = len(self.parents) - 1
            self.kind = tag
        names = " ".join(name for k, v in attrs if v and k in ("class", "id", "role") for name in v.split() if not MODIFIERS.match(name))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        if names:
            hinted = hinted or tag not in WHOLE_TAGS and (bool(BOILERPLATE_WORDS.search(names)) or bool(HEADER_WORDS.search(names)) and not article)
            content = content or bool(CONTENT_WORDS.search(names))
        bad = bad or tag in BOILERPLATE_TAGS or tag == "header" and not article
        self.places[tag].append(len(self.stack))
        if block:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, container, silent or tag in SILENT_TAGS or hidden, bad, hinted, article or tag in ("article", "main"), content, self.kind))
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS and tag != "a":
            fence = self.open_blocks[-1] if self.open_blocks else 0
        elif tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            fence = 0
        else:
            fence = self.last({"td", "th", "table", "body"} - {tag})
        if self.places[tag] and self.places[tag][-1] > fence:
            self.pop_to(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.anchors > 0:
                self.linked += len(data.strip())


def read_blocks(html: str) -> tuple[list[tuple], list[int]]:
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks, reader.parents


SENTENCE_END = re.compile(r"[.!?…](?:\s|$)")
SIGN = re.compile(r"©|\(c\)\s|all rights reserved|terms of (?:use|service)|privacy policy", re.I)


def log_odds(block: tuple) -> float:
    text, _, kind, linked, bad, hinted, article, content = block
    z = W["bias"] + W["length"] * min(len(text) / 80, 3.0) + W["sentence"] * min(len(SENTENCE_END.findall(text)), 3) + W["links"] * min(1.0, linked / len(text))
    z += W["boilerplate"] * bad + W["hinted"] * hinted + W["article"] * article + W["content"] * content
    z += W["paragraph"] * (kind == "p") + W["heading"] * (kind in ("h1", "h2", "h3", "h4", "h5", "h6")) + W["item"] * (kind == "li")
    if len(text) < 200 and SIGN.search(text):
        z += W["sign"]
    return z


class Cut:
    """Minimum cut of a graph with terminals, by shortest augmenting paths in level graphs."""

    def __init__(self, unary: list[float]) -> None:
        self.unary = unary
        self.n = len(unary)
        self.out: list[list[int]] = [[] for _ in range(self.n)]
        self.head: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, capacity: float) -> None:
        self.out[a].append(len(self.head))
        self.head.append(b)
        self.room.append(capacity)
        self.out[b].append(len(self.head))
        self.head.append(a)
        self.room.append(capacity)

    def source_side(self) -> list[bool]:
        supply = [max(u, 0.0) for u in self.unary]
        demand = [max(-u, 0.0) for u in self.unary]
        head, room, out = self.head, self.room, self.out
        while True:
            level = [-1] * self.n
            queue = deque(i for i in range(self.n) if supply[i] > 1e-9)
            for i in queue:
                level[i] = 0
            met = False
            while queue:
                v = queue.popleft()
                met = met or demand[v] > 1e-9
                for e in out[v]:
                    if room[e] > 1e-9 and level[head[e]] < 0:
                        level[head[e]] = level[v] + 1
                        queue.append(head[e])
            if not met:
                return [x >= 0 for x in level]
            place = [0] * self.n
            for s in range(self.n):
                while supply[s] > 1e-9 and level[s] == 0:
                    path, v = [], s
                    while demand[v] <= 1e-9:
                        edges = out[v]
                        while place[v] < len(edges):
                            e = edges[place[v]]
                            if room[e] > 1e-9 and level[head[e]] == level[v] + 1:
                                break
                            place[v] += 1
                        if place[v] < len(edges):
                            path.append(edges[place[v]])
                            v = head[path[-1]]
                        elif path:
                            v = head[path.pop() ^ 1]
                            place[v] += 1
                        else:
                            break
                    if demand[v] <= 1e-9:
                        break
                    amount = min([supply[s], demand[v], *(room[e] for e in path)])
                    supply[s] -= amount
                    demand[v] -= amount
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks, parents = read_blocks(html)
    odds = [log_odds(b) for b in blocks]
    if blocks and (min(odds) > 0 or max(odds) <= 0):
        return "\n\n".join(b[0] for b in blocks) if min(odds) > 0 else ""
    n = len(blocks)
    number: dict[int, int] = {}
    for b in blocks:  # containers on the way from blocks to the root
        c = b[1]
        while c >= 0 and c not in number:
            number[c] = n + len(number)
            c = parents[c]
    cut = Cut(odds + [0.0] * len(number))
    for i, b in enumerate(blocks):
        cut.join(i, number[b[1]], INSIDE)
        if i:
            cut.join(i - 1, i, NEAR if parents[b[1]] == parents[blocks[i - 1][1]] else FAR)
    for c, i in number.items():
        if parents[c] >= 0:
            cut.join(i, number[parents[c]], NESTED)
    side = cut.source_side()
    return "\n\n".join(b[0] for b, content in zip(blocks, side) if content)


def _main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(x) for x in batch], dtype=object)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each, in place of its html."""
    return pages.withColumn(out, F.pandas_udf(_main_texts, "string")(text_of(html_col))).drop(html_col)
