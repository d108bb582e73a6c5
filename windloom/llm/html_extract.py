"""Operator 5: main text of HTML pages by a minimum cut.

A page becomes a list of text blocks. A hand-set linear classifier gives each block a margin for being content (where it
stands, its class names, length, link density, sentence marks); the margin is the block's capacity to one of the two
terminals. Neighbouring blocks, and blocks under one parent element, are joined by smoothness edges. The minimum cut
labels all blocks of a page at once. Blocks whose margin outweighs all their edges are settled first, which leaves the
maximum flow a few undecided blocks.

Each page is worked off alone where it lies; nothing is shuffled.

Defined results: a null or empty page gives an empty text; broken markup is read as browsers do in outline (unknown closing
tags are ignored, missing ones end with their parent, quoted values may hold any sign, a page that ends inside a tag, a
comment or a script ends there); very long pages are read in one pass, and every block whole; repeated rows get the same
result; ties in the cut go to boilerplate; an empty table gives an empty one; other input columns are not read, whatever
their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

#: What follows a tag's name: the next quoted value, or the tag's end.
_STEP = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')|>""")
_NAME_OF_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
#: Elements whose content is text that no page shows, up to their own end tag.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
#: Elements of another language, which may close themselves.
_FOREIGN = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in ("svg", "math")}
_HIDDEN = {"noscript", "template", "select", "button", "datalist", "object", "canvas", "audio", "video"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end an open paragraph.
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
_MAIN = {"article", "main"}
_BAD_NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "popup", "promo", "promotion", "related", "reply", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "contentinfo", "complementary", "alert", "copyright", "pagination", "pager", "recommended"}
_GOOD_NAMES = {"article", "post", "story", "entry"}
#: First words of names that tell a state of the page, not what an element is.
_STATES = {"has", "with", "without", "no", "is", "fixed", "sticky", "hide", "show"}
_STOPS = ".!?,;:"
#: Smoothness: between neighbours in page order, between neighbours under one parent, and the share left across a region's edge.
NEXT, SIBLING, ACROSS = 0.8, 1.2, 0.1


class Block:
    __slots__ = ("text", "linked", "parent", "region", "main", "bad", "heading")

    def __init__(self, text, linked, parent, region, main, bad, heading):
        self.text, self.linked, self.parent, self.region, self.main, self.bad, self.heading = text, linked, parent, region, main, bad, heading


def _frame_of(name: str, attributes: str, parent: tuple, number: int) -> tuple:
    """(tag, number, region, in main, in boilerplate, hidden) of an element below ``parent``."""
    _, _, region, main, bad, hidden = parent
    if name in _MAIN:
        region, main = number, True
    hidden = hidden or name in _HIDDEN
    if name in _OUTSIDE or name == "header" and not main:
        region, bad = number, True
    if name in ("html", "body") or not attributes:
        return name, number, region, main, bad, hidden
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif key == "role" and value == "main":
            region, main = number, True
        elif key in ("class", "id", "role") and name != "main":  # a page's one main element is that by its tag
            for token in value.split():
                words = _WORDS.findall(token)
                if not words or words[0] in _STATES:
                    continue
                if _BAD_NAMES.intersection(words[:1] if name in _MAIN else words) or "header" in words and not main:
                    region, bad = number, True
                elif _GOOD_NAMES.intersection(words) and not bad:
                    region, main = number, True
    return name, number, region, main, bad, hidden


def tokens_of(page: str):
    """("text", text), ("open", name, attributes), ("close", name) or ("gap",), each in one pass over the page."""
    at, end = 0, len(page)
    while at < end:
        stop = page.find("<", at)
        if stop < 0:
            stop = end
        if stop > at:
            yield "text", page[at:stop]
        if stop == end:
            return
        follows = page[stop + 1 : stop + 2]
        if page.startswith("<!--", stop):
            short = next((x for x in ("<!-->", "<!--->") if page.startswith(x, stop)), None)
            close = stop + len(short) - 3 if short else page.find("-->", stop + 4)
            at = close + 3 if close >= 0 else end
            yield ("gap",)
            continue
        closing = follows == "/"
        m = _NAME_OF_TAG.match(page, stop + 1 + closing)
        if not m:
            if closing or follows in ("!", "?") and follows:
                close = page.find(">", stop)
                at = close + 1 if close >= 0 else end
            else:
                yield "text", "<"
                at = stop + 1
            continue
        at, name = m.end(), m[0].lower()
        while True:
            step = _STEP.search(page, at)
            if not step:
                return  # the page ends inside a tag
            at = step.end()
            if step[0] == ">":
                break
        attributes = page[m.end() : at - 1]
        if closing:
            yield "close", name
        elif name in _RAW:
            close = _RAW[name].search(page, at)
            if not close:
                return
            at = page.find(">", close.end()) + 1 or end
            yield ("gap",)
        elif name in _FOREIGN:
            depth = 0 if attributes.endswith("/") else 1
            while depth:
                tag = _FOREIGN[name].search(page, at)
                if not tag:
                    return
                at = page.find(">", tag.end()) + 1 or end
                depth += -1 if tag[1] else page[at - 2 : at - 1] != "/"
            yield ("gap",)
        else:
            yield "open", name, attributes


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [("", 0, 0, False, False, False)]
    text: list[str] = []
    linked = number = links = 0
    heading = False

    def close() -> None:
        nonlocal linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            _, parent, region, main, bad, hidden = stack[-1]
            if not hidden:
                above = stack[-2][1] if len(stack) > 1 else 0
                out.append(Block(joined, linked, above, region, main, bad, heading))
        text.clear()
        linked = 0

    for kind, *rest in tokens_of(page):
        if kind == "text":
            text.append(rest[0])
            if links:
                linked += len(rest[0])
            continue
        if kind == "gap":
            text.append(" ")
            continue
        name, opens = rest[0], kind == "open"
        if name in _INLINE:
            if name == "a":
                links = 1 if opens else 0  # links don't nest
            continue
        if name in ("br", "img", "input"):
            text.append(" ")
            continue
        close()
        links = 0
        heading = opens and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in _VOID:
            continue
        if not opens:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in _ENDS_P and stack[-1][0] in ("button", "select"):
                stack.pop()  # left open: what follows isn't its label
            if name in ("li", "tr", "td", "th", "dt", "dd") and stack[-1][0] == name or stack[-1][0] == "p" and name in _ENDS_P:
                stack.pop()  # its end tag may be left out
            number += 1
            stack.append(_frame_of(name, rest[1], stack[-1], number))
    close()
    return out


def margin(b: Block, marked: bool = True) -> float:
    """Above 0: content, below: boilerplate. Length and sentence marks of the whole block count, ever less as they grow.

    On a page that marks no main part, what stands outside of boilerplate may be short: its links and its neighbours tell more.
    """
    n, stops = len(b.text), sum(map(b.text.count, _STOPS))
    value = (-0.6 if marked else 0.2) + 2.4 * n / (n + 300) + 1.2 * stops / (stops + 4) - 3.0 * min(1.0, b.linked / n)
    if b.heading:
        value += 0.8
    if b.main:
        value += 5.0
    if b.bad:
        value -= 14.0
    return value


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = NEXT * (1 if blocks[i - 1].region == b.region else ACROSS)
        if b.parent in last:
            j = last[b.parent]
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING * (1 if blocks[j].region == b.region else ACROSS)
        last[b.parent] = i
    return edges


def minimum_cut(margins: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the blocks on the content side."""
    n = len(margins)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    value, label = list(margins), [None] * n
    ready = deque(range(n))
    while ready:  # a block whose terminal outweighs its open edges is settled; its edges then pull its neighbours
        i = ready.popleft()
        if label[i] is None and abs(value[i]) >= sum(w for j, w in near[i].items() if label[j] is None):
            label[i] = value[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    value[j] += w if label[i] else -w
                    ready.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        inside = _source_side({i: value[i] for i in left}, {i: {j: w for j, w in near[i].items() if label[j] is None} for i in left})
        for i in left:
            label[i] = i in inside
    return label


def _source_side(value: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Shortest augmenting paths from the blocks that lean to content (source) to the others (sink)."""
    rest = {i: dict(x) for i, x in near.items()}
    supply = {i: max(v, 0.0) for i, v in value.items()}
    demand = {i: max(-v, 0.0) for i, v in value.items()}
    while True:
        came: dict[int, int | None] = {i: None for i, s in supply.items() if s > 1e-9}
        queue, end = deque(came), None
        while queue:
            i = queue.popleft()
            if demand[i] > 1e-9:
                end = i
                break
            for j, w in rest[i].items():
                if w > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end is None:
            return set(came)
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        flow = min(supply[path[-1]], demand[end], *(rest[b][a] for a, b in zip(path, path[1:])))
        supply[path[-1]] -= flow
        demand[end] -= flow
        for a, b in zip(path, path[1:]):
            rest[b][a] -= flow
            rest[a][b] = rest[a].get(b, 0.0) + flow


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    marked = any(b.main for b in blocks)
    keep = minimum_cut([margin(b, marked) for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            for a, z in steps(batch.num_rows):
                part = batch.slice(a, z - a)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
