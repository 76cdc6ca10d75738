"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks (text between block-level tags, in page order).  Each block has two
costs, one if it is labelled content and one if it is labelled boilerplate, from a linear
classifier over its place (landmark tags, roles, words of class and id) and its text (length,
share of link text, sentence end).  These are the capacities to the two terminals of a graph.
Blocks that follow each other are joined by an edge whose capacity grows with the share of the
DOM path that they have in common, and blocks that follow each other in the same container by
a further one.  The labelling of least total cost is a minimum cut between the terminals; of
several such cuts the one with most content is taken.

Blocks whose own costs outweigh all their open edges are decided at once and hand their edge
capacities to their neighbours; the maximum flow runs over what is left, mostly a few blocks.

Results by case: a null page is the empty page and has the empty text; a page without a
content block has the empty text; rows with a null id are left out; an id that occurs on
several rows counts once, with the smallest html; markup that is not closed or not opened is
read as far as it goes and never an error; columns of other names are not read; an empty table
gives an empty result.  ``<br>`` is white space inside a block.

One page is the unit of work: a narrow map without a shuffle, one page in memory at a time.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import one_row_per_id, q, slices

# Parameters of the classifier, in units of cost.
LANDMARK = 30       # inside a landmark of content or boilerplate
HINT = 10           # class or id speaks of content
OUTSIDE = 10        # outside of the article that the page declares
LINKS = 14          # all of the text is link text
PHRASE = 6          # a short text with a phrase of page furniture
PROSE = 4           # a paragraph; a sentence end
PER_WORDS, AT_MOST_WORDS, FEW_WORDS = 4, 40, 14   # one unit for so many words, beyond so few
ADJACENT, SAME_CONTAINER = 4, 2
SCALE = 60          # capacities are integers

# HTML element names.
DROPPED = frozenset("script style noscript template iframe object svg canvas audio video select option button textarea input head title datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ALWAYS_FURNITURE = frozenset("nav footer aside menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation
breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
share sharing social related recommended recommendations widget toolbar pagination pager copyright legal disclaimer search skip""".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
CONTENT_WORDS = frozenset("article content post entry story main text body prose".split())
PHRASES = re.compile(r"©|\(c\)|\b(copyright|all rights reserved|cookies?|subscribe|newsletter|sign (in|up)|log ?in|privacy policy|terms of (use|service)|advertisement)\b", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
END = re.compile(r"[.!?…。！？:][\"'»”’)\]]*$")


class Block(NamedTuple):
    text: str
    link_share: float
    prose: bool         # its element is a paragraph or a heading
    landmark: int       # sum of the landmarks' evidence
    declared: bool      # inside an article or main element
    container: int
    depth: int
    shared: int         # depth of what it has in common with the block before


class Element(NamedTuple):
    tag: str
    container: int
    dropped: bool
    landmark: int
    stays: bool         # the landmark holds for all elements inside
    declared: bool


def said(words: list[str]) -> int:
    """Evidence of the words of a class or an id: below 0 furniture, -2 reader comments, above 0 content."""
    told = {w for i, w in enumerate(words) if i == 0 or words[i - 1] not in ("has", "with", "no", "without")}
    if told & COMMENT_WORDS:
        return -2
    if told & FURNITURE_WORDS:
        return -1
    if "header" in told and not told & CONTENT_WORDS:
        return -1
    return int(bool(told & CONTENT_WORDS))


class Blocks(HTMLParser):
    """Cuts a page into blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.lowest = 0
        self.containers = 0
        self.at: tuple[Element, int] | None = None

    # unknown sections such as <![if ...]> are read as comments
    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.at:
            element, depth = self.at
            links = min(1.0, self.linked / max(1, len(text) - text.count(" ")))
            self.blocks.append(Block(text, links, element.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"), element.landmark, element.declared,
                                     element.container, depth, self.lowest))
            self.lowest = depth
        self.parts, self.linked, self.at = [], 0, None

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            self.open[self.stack.pop().tag] -= 1
        self.lowest = min(self.lowest, len(self.stack))

    def close_open(self, tags: set[str], stops: set[str]) -> None:
        if not any(self.open[t] > 0 for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in tags:
                return self.pop_to(at)
            if self.stack[at].tag in stops:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            return self.parts.append(" ")
        if tag not in INLINE:
            self.flush()
            self.close_open({"p"}, {"td", "th", "table", "caption", "object", "button"})
            if tag in CLOSES:
                self.close_open(*CLOSES[tag])
        if tag == "body":  # an open head ends here
            self.close_open({"head"}, set())
        if tag in VOID:
            return None
        self.stack.append(self.element(tag, dict(attrs)))
        self.open[tag] += 1
        return None

    def element(self, tag: str, attrs: dict[str, str | None]) -> Element:
        above = self.stack[-1] if self.stack else Element("", 0, False, 0, False, False)
        container = above.container
        if tag not in INLINE and tag not in LEAVES:
            self.containers += 1
            container = self.containers
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        dropped = above.dropped or tag in DROPPED or hidden
        landmark, stays, declared = above.landmark, above.stays, above.declared
        if not stays and tag not in INLINE and tag not in ("html", "body"):
            role = (attrs.get("role") or "").lower()
            words = [w.lower() for w in WORDS.findall(f"{attrs.get('class') or ''} . {attrs.get('id') or ''}")]
            told = said(words) if words else 0
            if tag in ALWAYS_FURNITURE or told == -2:
                landmark, stays, declared = -LANDMARK, True, False
            elif tag == "form" or tag == "header" and not declared or role in FURNITURE_ROLES or told == -1:
                landmark, declared = -LANDMARK, False
            elif tag in ("article", "main") or role in ("article", "main"):
                landmark, declared = LANDMARK, True
            elif told == 1 and landmark == 0:
                landmark = HINT
        return Element(tag, container, dropped, landmark, stays, declared)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.open[tag] > 0:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at].tag == tag:
                    return self.pop_to(at)
        return None

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else Element("", 0, False, 0, False, False)
        if top.dropped:
            return
        if self.at is None and not data.isspace():
            depth = len(self.stack)
            while depth > 0 and self.stack[depth - 1].tag in INLINE:
                depth -= 1
            self.at = (self.stack[depth - 1] if depth else top, depth)
        self.parts.append(data)
        if self.open["a"] > 0:
            self.linked += len(data) - sum(map(str.isspace, data))


def page_blocks(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def content_costs(blocks: list[Block]) -> list[int]:
    """For each block, how much more it costs to label it boilerplate than content."""
    declares = any(b.declared for b in blocks)
    out = []
    for b in blocks:
        n = len(b.text.split())
        score = b.landmark + (min(n, AT_MOST_WORDS) - FEW_WORDS) / PER_WORDS - LINKS * b.link_share
        score += PROSE * b.prose + PROSE * bool(END.search(b.text)) - OUTSIDE * (declares and not b.declared)
        if n < AT_MOST_WORDS and PHRASES.search(b.text):
            score -= PHRASE
        out.append(round(SCALE * score))
    return out


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, later block, capacity)."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            common = min(b.shared, blocks[i - 1].depth, b.depth) / max(1, blocks[i - 1].depth, b.depth)
            edges.append((i - 1, i, round(SCALE * ADJACENT * common)))
        if b.container in last:
            edges.append((last[b.container], i, SCALE * SAME_CONTAINER))
        last[b.container] = i
    return [e for e in edges if e[2] > 0]


def minimum_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut with most nodes there.

    ``gains``: what a node costs on the sink's side less what it costs on the source's.
    """
    n = len(gains)
    gain = list(gains)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    weight = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # nodes whose own cost decides
        i = queue.popleft()
        if side[i] is not None or -weight[i] <= gain[i] < weight[i]:
            continue
        side[i] = gain[i] >= weight[i]
        for j, w in near[i].items():
            if side[j] is None:
                gain[j] += w if side[i] else -w
                weight[j] -= w
                queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        sink_side = flow_sink_side(rest, gain, near, side)
        for i in rest:
            side[i] = i not in sink_side
    return [bool(s) for s in side]


def flow_sink_side(rest: list[int], gain: list[int], near: list[dict[int, int]], side: list[bool | None]) -> set[int]:
    """Maximum flow by shortest augmenting paths in phases; the nodes that can still reach the sink."""
    left = {i: {j: w for j, w in near[i].items() if side[j] is None} for i in rest}
    source = {i: gain[i] for i in rest if gain[i] > 0}
    sink = {i: -gain[i] for i in rest if gain[i] < 0}
    while True:
        far = {i: 0 for i, c in sink.items() if c > 0}  # distance to the sink over open edges
        queue = deque(far)
        while queue:
            i = queue.popleft()
            for j in left[i]:
                if j not in far and left[j][i] > 0:
                    far[j] = far[i] + 1
                    queue.append(j)
        starts = [i for i, c in source.items() if c > 0 and i in far]
        if not starts:
            return set(far)
        to_try = {i: iter(left[i]) for i in far}
        for start in starts:
            path = [start]
            while path and source[start] > 0:
                i = path[-1]
                if far[i] == 0 and sink.get(i, 0) > 0:
                    amount = min(source[start], sink[i], *(left[a][b] for a, b in zip(path, path[1:])))
                    source[start] -= amount
                    sink[i] -= amount
                    for a, b in zip(path, path[1:]):
                        left[a][b] -= amount
                        left[b][a] += amount
                    path = [start]
                    to_try[start] = iter(left[start])
                    continue
                for j in to_try[i]:
                    if far.get(j, -1) == far[i] - 1 and left[i][j] > 0:
                        path.append(j)
                        break
                else:
                    path.pop()


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of a page."""
    blocks = page_blocks(html or "")
    keep = minimum_cut(content_costs(blocks), smoothness(blocks))
    kept = [b.text for b, k in zip(blocks, keep) if k]
    return "\n".join(kept), len(blocks), len(kept)


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_blocks int, n_kept int) for every page, and the columns named in ``keep``."""
    rows = one_row_per_id(df.select(*[F.col(q(c)) for c in dict.fromkeys([id_col, html_col, *keep])]), id_col, html_col)
    rows = rows.select(F.col(q(id_col)).cast("bigint").alias("id"), F.col(q(html_col)).cast("string").alias("html"), *[F.col(q(c)).alias(f"k{i}") for i, c in enumerate(keep)])
    carried = [c for c in rows.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [main_text(x.as_py()) for x in part.column(1)]
            text, blocks, kept = zip(*found) if found else ((), (), ())
            columns = [part.column(0), *(part.column(i) for i in range(2, part.num_columns)), pa.array(text, pa.string()), pa.array(blocks, pa.int32()), pa.array(kept, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "text", "n_blocks", "n_kept"])

    schema = T.StructType([rows.schema[c] for c in carried]).add("text", "string").add("n_blocks", "integer").add("n_kept", "integer")
    out = rows.mapInArrow(run, schema)
    return out.select("id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_blocks", "n_kept")
