"""Main text of HTML pages by a minimum cut.

A page is cut into blocks of text at block-level tags. A linear classifier gives each block
log-odds of being content, from where it stands (article, menu, advert and so on, by tags,
roles and class names), its links, length and punctuation. The log-odds become capacities to
two terminals, and blocks that follow each other, or stand near each other in the tree of
elements, are joined by smoothness edges. Maximum flow saturates the cheapest cut: the blocks
still reachable from the content terminal are the main text. Blocks keep their page order.

The tables label no blocks, so the classifier's weights are stated (`Costs`), not learned.

Character references are decoded as HTML5 says (`&amp` without its semicolon too), white space
within a block becomes one blank, blocks are joined by one line break. Scripts, styles,
comments of the markup, controls and hidden elements are never text. Broken markup is read as
far as it goes: an unclosed tag or comment runs to the page's end, unknown end tags are
skipped. Null and empty pages give an empty text, repeated rows repeated results, null ids
stay; columns not named are left out, so none can clash. Pages are worked on whole, in Arrow
batches, without a shuffle; a long page needs some ten times its size in memory.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwell.llm.common import pieces

# The kinds of HTML elements, and words of class names, ids and roles that tell what an element holds.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
BREAKS = frozenset(["hr", "option", "optgroup"])
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist head map math noscript object select svg template video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
TAGS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "search": "form", "dialog": "notice", "article": "article", "main": "article"}
ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "alertdialog": "notice", "menu": "menu", "menubar": "menu", "main": "article", "article": "article", "toolbar": "menu"}
NAMES = {
    "comments": "comment comments commentlist commentary disqus replies reply respond discussion reviews",
    "advert": "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion promoted sponsor sponsored sponsors dfp taboola outbrain",
    "notice": "notice notices notification cookie cookies consent gdpr privacy alert alerts popup modal overlay paywall disclaimer toast lightbox",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination paging toolbar skip topbar tabs toc",
    "header": "header masthead topper",
    "footer": "footer copyright colophon legal imprint",
    "aside": "sidebar aside related recommended recommendations recirc share sharing social follow widget widgets rail trending popular teaser teasers byline author meta tags tagcloud outro more",
    "form": "form login signin signup register search newsletter subscribe subscription subscribeform contactform poll",
    "hint": "article articlebody content post entry story text body main maincontent prose",
}
NOT_NAMES = frozenset(["has", "with", "no", "without", "is", "hide", "open"])
# End of fixed values.
KIND_OF = {word: kind for kind, words in NAMES.items() for word in words.split()}
#: Kinds that an article inside leaves behind; the others hold what lies in them, articles too.
WRAPPERS = frozenset(["", "hint", "menu", "header", "form"])

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
OWN_WORDS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b", re.I)


@dataclass(frozen=True)
class Costs:
    """Log-odds of content by feature, and capacities of the smoothness edges."""

    bias: float = 0.5
    article: float = 5.0
    hint: float = 3.0
    apart: float = -7.0  # in a menu, header, footer, aside, notice, advert, form or comments
    links: float = -3.0  # times the share of characters in links
    length: float = 0.8  # times log2(characters / 40), from -2 to 4
    sentence: float = 0.5  # ends like a sentence; else its negative
    paragraph: float = 0.5
    heading: float = 0.8
    item: float = -0.5  # list items and cells
    own_words: float = -2.0
    adjacent: float = 0.4
    sibling: float = 1.0  # in the same parent element as an earlier block
    cousin: float = 0.4  # in the same element above it


@dataclass
class Element:
    name: str
    kind: str
    above: Element | None


@dataclass
class Block:
    text: str
    kind: str
    element: Element
    link_share: float


def kind_within(name: str, attributes: str, outer: str) -> str:
    """What an element holds: its own kind, or the one around it."""
    kind, hinted = TAGS.get(name, ""), ""
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "unseen"
            if key == "role":
                kind = ROLES.get(value.lower(), kind)
            elif key == "itemprop" and value.lower() == "articlebody":
                kind = "article"
            elif key in ("class", "id") and name not in ("html", "body"):
                for one in value.split():
                    words = [w.lower() for w in WORD.findall(one)]
                    if not NOT_NAMES.intersection(words):
                        kinds = [KIND_OF[w] for w in words if w in KIND_OF]
                        apart = [k for k in kinds if k != "hint"]
                        hinted = (apart or kinds or [hinted])[0] if hinted in ("", "hint") else hinted
    if name in UNSEEN:
        return "unseen"
    if kind == "article":
        kind = hinted if hinted in ("comments", "advert") else kind
    elif hinted and (hinted != "hint" or not kind):
        kind = hinted
    if outer == "unseen" or outer not in WRAPPERS and outer != "article":
        return outer
    if outer == "article":
        return "article header" if kind == "header" else kind if kind not in ("", "hint") else outer
    if outer in ("menu", "header", "form"):
        return kind if kind == "article" else outer
    return kind or outer


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    top = Element("", "", None)
    node, found = top, []
    parts: list[str] = []
    sizes = [0, 0]  # characters outside and inside of links
    linked, at = False, 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text and node.kind != "unseen":
                found.append(Block(text, node.kind, node, sizes[1] / max(1, sum(sizes))))
            parts.clear()
            sizes[:] = 0, 0

    def add(text: str) -> None:
        if text:
            parts.append(html.unescape(text) if "&" in text else text)
            sizes[linked] += len(text)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "a":
            linked = not closing
        elif name == "br":
            parts.append(" ")
        elif name in RAW and not closing:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
        elif name in BREAKS:
            flush()
        elif name in BLOCKS or name in UNSEEN:
            flush()
            linked = False
            if closing:
                up = node
                while up.above and up.name != name:
                    up = up.above
                node = up.above or node
                continue
            ends = CLOSED_BY.get(name, ())
            if name in BLOCKS and node.name == "p":
                node = node.above
            while node.name in ends:
                node = node.above
            if not attributes.endswith("/") or name in BLOCKS:
                node = Element(name, kind_within(name, attributes, node.kind), node)
        elif attributes and not closing and name not in VOID and kind_within(name, attributes, node.kind) == "unseen":
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)  # an inline element that isn't shown
            at = stop.end() if stop else at
    flush()
    return found


def log_odds(block: Block, costs: Costs) -> float:
    """The classifier: above 0, the block looks like content."""
    text, kind, tag = block.text, block.kind, block.element.name
    out = costs.bias + costs.length * min(4.0, max(-2.0, log2(len(text) / 40))) + costs.links * block.link_share
    out += costs.sentence if text[-1] in ".!?…:;\"'”»)。！？" else -costs.sentence
    heading = tag[:1] == "h" and tag[1:].isdigit()
    out += costs.paragraph if tag in ("p", "blockquote", "pre") else costs.item if tag in ("li", "td", "th", "dt", "dd") else costs.heading * heading
    if kind == "article header":
        kind = "article" if heading else "header"
    if kind == "article":
        return out + costs.article
    if kind == "hint":
        out += costs.hint
    elif kind:
        out += costs.apart
    return out + costs.own_words * bool(OWN_WORDS.search(text))


def edges_of(blocks: list[Block], costs: Costs) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the block before, and to the last one of the same parent, or else to the last one anywhere within it or within the element above."""
    out, own, within = [], {}, {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, costs.adjacent))
        up = b.element.above or b.element
        above = up.above or up
        if id(up) in own:
            out.append((own[id(up)], i, costs.sibling))
        elif (j := within.get(id(up), within.get(id(above)))) is not None:
            out.append((j, i, costs.cousin))
        own[id(up)] = within[id(up)] = within[id(above)] = i
    return out


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]], unit: int = 1000) -> list[bool]:
    """Whether each node is on the content side of the minimum cut.

    A node with positive odds is fed by the content terminal, one with negative odds drains to
    the other, by as much; edges carry either way. Shortest augmenting paths are taken from
    each fed node. When none is left from it, the nodes it still reaches are cut off from the
    drain for good: that is the content side. Capacities are whole numbers, so flows are exact.
    """
    n = len(odds)
    left = [round(o * unit) for o in odds]  # what can still be fed, or drained if negative
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            room[a][b] = room[a].get(b, 0) + round(c * unit)
            room[b][a] = room[b].get(a, 0) + round(c * unit)
    content = [False] * n
    for start in range(n):
        while left[start] > 0 and not content[start]:
            came, queue, goal = {start: start}, deque([start]), -1
            while queue and goal < 0:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 0 and v not in came and not content[v]:
                        came[v] = u
                        if left[v] < 0:
                            goal = v
                            break
                        queue.append(v)
            if goal < 0:
                for v in came:
                    content[v] = True
                break
            flow, v = min(left[start], -left[goal]), goal
            while v != start:
                flow, v = min(flow, room[came[v]][v]), came[v]
            left[start] -= flow
            left[goal] += flow
            v = goal
            while v != start:
                u = came[v]
                room[u][v] -= flow
                room[v][u] += flow
                v = u
    return content


def main_text(page: str | None, costs: Costs = Costs()) -> str:
    """The main text of a page."""
    blocks = blocks_of(page or "")
    keep = minimum_cut([log_odds(b, costs) for b in blocks], edges_of(blocks, costs))
    return "\n".join(b.text for b, kept in zip(blocks, keep) if kept)


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",), costs: Costs = Costs()) -> DataFrame:
    """id, the columns of keep, text and n_chars (code points) of each page."""
    rows = pages.select(id_column, *keep, html_column)
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(keep) + 1):
            texts = [main_text(t, costs) for t in batch.column(len(keep) + 1).to_pylist()]
            schema = pa.schema([*[batch.schema.field(i) for i in range(len(keep) + 1)], ("text", pa.string()), ("n_chars", pa.int64())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return rows.mapInArrow(work, f"{fields}, text string, n_chars long")
