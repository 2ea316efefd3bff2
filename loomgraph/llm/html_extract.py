"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams its events into lines, one a block
element.  Each line has the ratio of its characters outside links to its tags,
divided by a thousand where tag, role, class or id speak of page furniture.  The
ratios are smoothed with a Gaussian window.  A line is content if the smoothed
ratio is above a threshold (a share of its standard deviation) and its own ratio
does not fall far below it, which is what sets an advert between paragraphs
apart.  The content lines choose the region: an article or main element that
holds at least half of their text, else the smallest element that holds nine
tenths.  The result is the region's lines: the content lines, and all others
that nothing speaks against, but for runs of links before the first and after
the last content line of a region that is no article.

A name like "sidebar" says nothing on an element that holds the page's first
heading of the highest rank and half of its text (layouts are named so, and a
form may hold the whole page), nor after "no", "with" and the like.  Scripts,
styles, form fields and what is hidden give no lines at all.  Time is linear in
the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused_name

# Fixed values of HTML and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
SPACE = frozenset("br td th".split())
#: Elements that give no lines, and those that speak of furniture.
DROPPED = frozenset("audio button canvas datalist dialog embed frame frameset head iframe input math noframes noscript object option script select style svg template textarea title video".split())
SIDE_TAGS = frozenset("aside footer form menu nav search".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CLOSES_P = BLOCK - {"body", "head", "html", "caption", "legend", "option", "optgroup", "tbody", "tfoot", "thead", "tr", "title"}
SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE = frozenset(
    "ad adbanner adbox ads adsense adslot adunit advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookiebar cookies disclaimer discussion disqus footer "
    "gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup popover promo promos promoted promotion recommended related replies "
    "respond responses search share sharing sidebar sidemenu sidenav signup skip social sponsor sponsored sponsors submenu subnav subscribe subscription toolbar topmenu topnav widget widgets".split()
)
#: Furniture only outside an article.
OUTSIDE = frozenset("alert header masthead side topbar".split())
CONTENT = frozenset("article body content entry main post story text".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
#: Words of a name that turn what follows into a layout's description.
LAYOUT = frozenset("has hide no not with without".split())
SIGMA = 1.0
#: Share of the standard deviation above which a smoothed ratio is content, and share of it that the line's own ratio must reach.
THRESHOLD, OWN = 0.5, 0.1
#: Characters a tag, after the division, that any content has.
FLOOR = 1.0
EVIDENCE = 0.001


def _words(value: str) -> set[str]:
    return {w.lower() for w in WORD.findall(value)}


_seen: dict[str, tuple[bool, bool]] = {}


def _furniture(value: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture, and furniture of a page outside its article."""
    got = _seen.get(value)
    if got is None:
        if len(_seen) > 10_000:
            _seen.clear()
        each = [w for name in value.split() if not (w := _words(name)) & LAYOUT]
        got = _seen[value] = (any(w & FURNITURE for w in each), any(w & OUTSIDE and not w & CONTENT for w in each))
    return got


class Lines(HTMLParser):
    """Lines of a page and its elements.  Each open element has: tag, whether it gives no lines, whether it lies in an article, its number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
        #: Places in the stack of open elements by tag, of blocks, and of blocks and cells.
        self.at: dict[str, list[int]] = {}
        self.blocks, self.edges = [0], [0]
        self.parents, self.tags, self.side = [-1], [""], [False]
        self.parts: list[str] = []
        self.links = self.count = 0
        #: text, its characters outside links, all its characters (but spaces), tags since the line before, element
        self.lines: list[tuple[str, int, int, int, int]] = []

    def _flush(self) -> None:
        words = "".join(self.parts).split() if self.parts else ()
        if words:
            size = sum(map(len, words))
            self.lines.append((" ".join(words), size - self.links, size, self.count, self.open[-1][3]))
            self.count = 0
        self.parts, self.links = [], 0

    def _pop_to(self, to: int) -> None:
        for tag, *_ in reversed(self.open[to:]):
            self.at[tag].pop()
        del self.open[to:]
        for places in (self.blocks, self.edges):
            while places[-1] >= to:
                places.pop()

    def _last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        if tag in BLOCK:
            self._flush()
        elif tag in SPACE:
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P and (p := self._last("p")) > 0 and p == self.edges[-1]:
            self._pop_to(p)
        if tag in SAME and (last := self._last(*(("dd", "dt") if tag in ("dd", "dt") else (tag,)))) > self._last(*SAME[tag]):
            self._pop_to(last)
        _, dropped, inside, parent = self.open[-1]
        inside = inside or tag in ("article", "main")
        side = tag in SIDE_TAGS or (tag == "header" and not inside)
        dropped = dropped or tag in DROPPED
        if not dropped and attrs and tag not in ("html", "body", "article", "main", "a"):
            for name, value in attrs:
                if name == "hidden" or (name == "aria-hidden" and value == "true"):
                    dropped = True
                elif not value:
                    continue
                elif name in ("class", "id"):
                    always, outside = _furniture(value)
                    side = side or always or (outside and not inside)
                elif name == "role":
                    side = side or value.lower() in ROLES
                elif name == "style":
                    dropped = dropped or "display:none" in value.replace(" ", "").lower()
        here = len(self.open)
        self.at.setdefault(tag, []).append(here)
        if tag in BLOCK:
            self.blocks.append(here)
        if tag in BLOCK or tag in SPACE:
            self.edges.append(here)
        self.open.append((tag, dropped, inside, len(self.parents)))
        self.parents.append(parent)
        self.tags.append(tag)
        self.side.append(side)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use", "circle", "rect"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        if tag in BLOCK:
            self._flush()
        elif tag in SPACE:
            self.parts.append(" ")
        last = self._last(tag)
        # An inline end tag closes nothing beyond its block.
        if last > 0 and (tag in BLOCK or tag in SPACE or last > self.blocks[-1]):
            self._pop_to(last)

    def handle_data(self, data: str) -> None:
        if self.open[-1][1]:
            return
        self.parts.append(data)
        if self.at.get("a"):
            self.links += sum(map(len, data.split()))

    def finish(self) -> list[tuple[str, int, int, int, int]]:
        self.close()
        self._flush()
        return self.lines


def furniture(page: Lines) -> list[bool]:
    """Whether each element lies in page furniture.

    An element that speaks of furniture is none if it holds half of the text
    (what lies in furniture within it left out) and the page's first heading of
    the highest rank; on a page without headings, four fifths of the text.
    """
    n = len(page.parents)
    mass, holds, side = [0] * n, [False] * n, list(page.side)
    first: dict[str, int] = {}
    for _, _, size, _, element in page.lines:
        mass[element] += size
        e = element
        for _ in range(4):  # a heading's text may stand in inline elements
            if page.tags[e] in HEADINGS:
                first.setdefault(page.tags[e], e)
            e = max(0, page.parents[e])
    total = sum(mass)
    heading = next((first[h] for h in HEADINGS if h in first), None)
    if heading is not None:
        holds[heading] = True
    for e in range(n - 1, 0, -1):
        if side[e] and page.tags[e] not in ("nav", "footer", "aside"):
            side[e] = not (2 * mass[e] >= total and holds[e] if heading is not None else 5 * mass[e] >= 4 * total)
        if not side[e]:
            mass[page.parents[e]] += mass[e]
            holds[page.parents[e]] |= holds[e]
    for e in range(1, n):
        side[e] = side[e] or side[page.parents[e]]
    return side


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), window / window.sum(), mode="valid")


def main_text(html: str) -> str:
    """The main text: lines joined by two line feeds; empty if there is none."""
    page = Lines()
    page.feed(html)
    lines = page.finish()
    if not lines:
        return ""
    side = furniture(page)
    own = np.array([outside / max(1, tags) * (EVIDENCE if side[e] else 1.0) for _, outside, _, tags, e in lines])
    smooth = smoothed(own)
    least = THRESHOLD * float(smooth.std())
    content = ((smooth > least) & (own >= np.maximum(FLOOR, OWN * smooth)) if THRESHOLD >= 0 else np.ones(len(own), bool)).tolist()
    if not any(content):
        content = [not side[x[4]] for x in lines]
    # Text of content lines by element, gathered upwards; an element's number is above its parent's.
    n = len(page.parents)
    mass = [0] * n
    for (_, outside, _, _, e), is_content in zip(lines, content):
        mass[e] += outside if is_content else 0
    for e in range(n - 1, 0, -1):
        mass[page.parents[e]] += mass[e]
    total = mass[0]
    chosen = [e for e in range(n) if page.tags[e] in ("article", "main") and total and 2 * mass[e] >= total]
    if chosen:
        # The innermost of those that hold nearly as much as the fullest.
        most = max(mass[e] for e in chosen)
        region = max(e for e in chosen if 10 * mass[e] >= 9 * most)
    else:
        region = max((e for e in range(n) if 10 * mass[e] >= 9 * total), default=0) if total else 0
    inside = [False] * n
    for e in range(n):
        inside[e] = e == region or (e > region and inside[page.parents[e]])
    here = [(x, c) for x, c in zip(lines, content) if inside[x[4]]]
    marks = [i for i, (_, c) in enumerate(here) if c]
    start, stop = (marks[0], marks[-1]) if marks else (0, len(here))
    kept = []
    for i, ((text, outside, size, _, e), is_content) in enumerate(here):
        link_run = not chosen and not start <= i <= stop and 2 * outside < size
        if is_content or not (side[e] or link_run):
            kept.append(text)
    return "\n\n".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        html = batch.column(last)
        for at in range(0, len(html), 256):
            texts = ["" if x is None else main_text(x) for x in html.slice(at, 256).to_pylist()]
            rest = [batch.column(c).slice(at, 256) for c in range(last)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=batch.schema.names)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages without the html column, with the main text (never null; null or empty html gives an empty text).

    A column of pages that bears the new name is replaced.  Repeated rows are
    worked out each for itself, with the same result.  A very long page is one
    row of one task, in time linear in its length.  No shuffle.
    """
    keep = [c for c in pages.columns if c not in (html_col, name)]
    narrow = pages.select(*keep, F.col(html_col))
    text = T.StructField(unused_name(narrow, "loom_text"), T.StringType())
    out = narrow.mapInArrow(_extracted, T.StructType([*pages.select(*keep).schema.fields, text]))
    return out.withColumnRenamed(text.name, name)
