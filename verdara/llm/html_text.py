"""Main text of web pages by composite text density.

Every page becomes a small DOM, without parts that are never shown. For every node the composite
density is computed: characters per tag, damped where many of the characters stand in links,
relative to the links of the whole body. Element and class names that usually mark menus, headers,
footers, sidebars, notices, adverts, forms or reader comments weigh a node's density down; a
marked node around everything leaves all choices inside it as they are. Densities of child blocks
are summed, and the node of the largest sum is the article. The least density on the path from the
body to it is the threshold: a subtree beside that path with at least this density is article text
too. Marked parts that don't hold the article are left out of the text whatever their density;
on the given pages these names decide more than the densities do. The article's blocks are
joined in page order, each with its white space folded.

Defined cases: null or empty html and pages without text give the empty text; broken or unclosed
markup is repaired as browsers do for paragraphs, list items and table cells, an unclosed comment
reaches to the end, unknown declarations are comments; of equal sums the first node in page order
is the article; depth is not limited; pages of any length are parsed whole, in time that grows with
their length, or with its square where quotes inside tags are opened again and again and never closed; repeated rows are treated alike; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import chunks

# Element and word lists of the HTML standard and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template button select textarea iframe object svg canvas dialog menu head title audio video map datalist".split())
MARKED = frozenset("nav footer aside form header".split())
BLOCK = frozenset(
    "html body address article blockquote caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
KEPT = frozenset(("article", "main", "body", "html"))
WORD = re.compile(r"[a-z]+")
#: Factor on the density of a node for each marked node around it, itself included.
WEIGHT = 0.02


class Dom(HTMLParser):
    """Nodes in page order, parents before children; text is kept as (node, string) in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.unseen, self.marked = ["#root"], [0], [False], [False]
        self.texts: list[tuple[int, str]] = []
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # of every open tag in the stack

    def judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether an element is never shown, and whether its names mark it as something else than article text."""
        if tag in KEPT:
            return False, False
        unseen, marked = tag in NEVER, tag in MARKED
        if tag == "header" and (self.places.get("article") or self.places.get("main")):
            marked = False
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                unseen = True
            if name == "role" and value in ROLES or name in ("class", "id") and not NAMES.isdisjoint(WORD.findall(value)):
                marked = True
        return unseen, marked

    def last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.tag[self.open.pop()]].pop()

    def close_back_to(self, tags: set[str] | frozenset[str], limits: set[str]) -> None:
        place = self.last(tags)
        if place > self.last(limits):
            self.close_from(place)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self.close_back_to(CLOSES[tag], LIMITS[tag])
        if tag in BLOCK:
            self.close_back_to({"p"}, {"table", "td", "th", "li", "div", "article", "section", "button", "body"})
        unseen, marked = self.judged(tag, attrs)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.unseen.append(self.unseen[self.open[-1]] or unseen)
        self.marked.append(marked)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.tag) - 1)
        elif tag in ("br", "hr", "wbr"):
            self.texts.append((len(self.tag) - 1, "" if tag == "wbr" else " "))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if place := self.last({tag}):
            self.close_from(place)

    def handle_data(self, data: str) -> None:
        if not self.unseen[self.open[-1]]:
            self.texts.append((self.open[-1], data))

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Where the comment at ``i`` ends: at the end of the page, if it is never closed."""
        data = self.rawdata
        if data.startswith((">", "->"), i + 4):
            return data.index(">", i + 4) + 1
        ends = [(k, len(mark)) for mark in ("-->", "--!>") if (k := data.find(mark, i + 4)) >= 0]
        return sum(min(ends)) if ends else len(data)

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        k = self.rawdata.find(">", i)
        return k + 1 if k >= 0 else len(self.rawdata)


def densities(dom: Dom) -> tuple[list[float], list[float], list[int]]:
    """Weighted composite density of every node, the sum of those of its child blocks, and its characters outside marked parts."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked, weight, block = [False] * n, [1.0] * n, [0] * n
    for i in range(1, n):
        p = dom.parent[i]
        linked[i] = dom.tag[i] == "a" or linked[p]
        weight[i] = weight[p] * (WEIGHT if dom.marked[i] else 1.0)
        block[i] = i if dom.tag[i] in BLOCK else block[p]
    for i, text in dom.texts:
        size = len("".join(text.split()))
        chars[i] += size
        link_chars[i] += size * linked[i]
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        if not dom.unseen[i]:
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (dom.tag[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    plain = [0] * n
    for i, text in dom.texts:
        plain[i] += len("".join(text.split()))
    for i in range(n - 1, 0, -1):
        if not dom.marked[i]:
            plain[dom.parent[i]] += plain[i]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i] and not dom.unseen[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = weight[i] * c / t * math.log(c / max(1, lc) * t / max(1, lt) + 1) / max(base, 1.0)
            if block[i] == i and i:
                total[block[dom.parent[i]]] += density[i]
    return density, total, plain


def main_text(html: str | None) -> str:
    """The article of a page, one line per block."""
    if not html:
        return ""
    dom = Dom()
    dom.feed(html)
    dom.close()
    n = len(dom.tag)
    density, total, plain = densities(dom)
    best = max(range(n), key=lambda i: (total[i], -i))
    within = [0] * n  # the densest of the marked nodes below each node
    for i in range(n - 1, 0, -1):
        own, p = i if dom.marked[i] else within[i], dom.parent[i]
        if own and (not within[p] or (total[own], density[own]) >= (total[within[p]], density[within[p]])):
            within[p] = own
    while not plain[best] and within[best]:  # nothing but marked parts: the article is in one of them
        best = within[best]
    path = {best}
    k = best
    while k:
        k = dom.parent[k]
        path.add(k)
    body = max((i for i in path if dom.tag[i] in ("body", "html")), default=0)
    threshold = min((density[i] for i in path if i >= body and density[i] > 0), default=0.0)
    inside = [False] * n
    for i in range(n):
        p = dom.parent[i]
        if dom.unseen[i] or dom.marked[i] and i not in path:
            continue
        beside = p in path and p < best and i not in path and dom.tag[i] in BLOCK and density[i] >= threshold > 0
        inside[i] = i == best or beside or i > 0 and inside[p]
    block_of = [0] * n
    for i in range(1, n):
        block_of[i] = i if dom.tag[i] in BLOCK else block_of[dom.parent[i]]
    blocks: list[str] = []
    pieces: list[str] = []
    current = None
    for i, text in dom.texts:
        if not inside[i]:
            continue
        if block_of[i] != current:
            blocks.append("".join(pieces))
            pieces, current = [], block_of[i]
        pieces.append(text)
    blocks.append("".join(pieces))
    return "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    rows = pages.select(F.struct("page_id", "url").alias("row"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(main_text, part.column(1).to_pylist()), pa.string())], ["row", "text"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return made.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
