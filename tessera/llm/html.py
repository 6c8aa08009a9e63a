"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one for each block. A line's ratio is its
characters that are no link's, over its tags; lines of menus, headers, footers, sidebars, notices, adverts, forms,
comments and anything hidden count 0. The ratios are smoothed along the page and split in two clusters. The content
region is the innermost element that holds nearly all text of the higher cluster, so short lines between paragraphs
stay. From there it grows to the enclosing article or main, and on to each parent all of whose other lines are headings,
paragraphs of its own, or lines of the higher cluster: titles and leads beside a long section stay, while menus and
notices beside it go, whatever their classes are called. Inside the region, an element of which all lines lie in the lower
cluster and most text is links goes as well.

Defined results: null or empty html, or a page without text: an empty string; broken markup is parsed as far as
it goes; null page_id or url and repeated rows: row by row; an empty table: no rows. Time and memory grow with the
page, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHARE, SIGMA = 0.9, 1.0
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "blockquote", "pre"}
DROPPED = frozenset("nav footer aside button select dialog menu script style noscript template svg iframe head title textarea object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
WHOLE = frozenset("ad ads adv nav navbar navigation menu header masthead banner hidden login signup toolbar pager search legal consent gdpr reply replies responses".split())
BEGIN = re.compile(r"breadcrumb|sidebar|comment|disqus|footer|pagination|menu")
#: Names that articles have too (social-studies, cookie-recipes): like a form, such a block is judged by what it holds.
DOUBTFUL = re.compile(r"advert|sponsor|promo|cookie|notice|popup|modal|newsletter|subscri|share|social|related|recommend|widget")
#: Doubtful elements inside each other that are judged; deeper ones are dropped.
MOST_DOUBTS = 16
#: Characters of paragraphs that a doubtful block must hold to be content, and how many times those of the page outside of it.
LEAST, TIMES = 200, 2
PARTS = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, bool]:
    """Whether an element is never content (inside an article, a header belongs to it), and whether that is in doubt."""
    doubt = tag == "form"
    if tag in DROPPED or tag == "header" and not inside:
        return True, False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value or ""):
            return True, False
        if name == "role" and (value or "").lower() in ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for part in PARTS.split((value or "").lower()):
                if part in WHOLE and not (inside and part in ("header", "banner")) or BEGIN.match(part):
                    return True, False
                doubt = doubt or DOUBTFUL.match(part) is not None
    return False, doubt


class _Line(NamedTuple):
    """A block's text, its tags, characters of links, whether nothing drops it, its element, whether that is a heading or paragraph, and the doubtful elements around it."""

    text: str
    tags: int
    linked: int
    kept: bool
    element: int
    prose: bool
    doubts: tuple[int, ...]


class _Lines(HTMLParser):
    """The lines of a page, and its block elements: parents, and the first line and the line after the last of each.

    An element's number is larger than its parent's, and its lines follow each other. whole holds articles and mains.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.parent, self.begin, self.end, self.tag = [0], [0], [None], ["html"]
        #: Open elements: tag, whether it drops its text, and the block element whose lines its text belongs to.
        self.stack: list[tuple[str, bool, int]] = []
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.dropped = self.linked = 0
        self.whole: set[int] = set()
        #: Doubtful elements that are open.
        self.doubts: tuple[int, ...] = ()

    @property
    def block(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def flush(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                block = self.block
                self.lines.append(_Line(text, max(1, self.tags), self.linked, not self.dropped, block, self.tag[block] in PROSE, self.doubts))
            self.text, self.tags, self.linked = [], 0, 0

    def pop(self, at: int):
        for tag, drop, block in reversed(self.stack[at:]):
            self.dropped -= drop
            self.open[tag] -= 1
            if tag not in INLINE:
                self.end[block] = len(self.lines)
                if self.doubts and self.doubts[-1] == block:
                    self.doubts = self.doubts[:-1]
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        inline = tag in INLINE
        if not inline:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if not inline:
            for at in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[at][0]
                if open_tag == "p" or open_tag == tag == "li" or open_tag == tag == "option" or {open_tag, tag} <= {"dt", "dd"} or {open_tag, tag} <= {"td", "th"}:
                    self.pop(at)
                    break
                if open_tag not in INLINE and open_tag not in HEADINGS:
                    break
        drop, doubt = _boilerplate(tag, attrs, self.open["article"] + self.open["main"] > 0)
        drop = drop or doubt and inline
        if drop and inline:
            self.text.append(" ")
            self.flush()
        block = self.block
        if not inline:
            self.parent.append(block)
            self.begin.append(len(self.lines))
            self.end.append(None)
            self.tag.append(tag)
            block = len(self.parent) - 1
            if tag in ("article", "main"):
                self.whole.add(block)
            if doubt and len(self.doubts) < MOST_DOUBTS:
                self.doubts += (block,)
            drop = drop or doubt and block not in self.doubts[-1:]
        self.stack.append((tag, drop, block))
        self.open[tag] += 1
        self.dropped += drop

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.open[tag]:
            at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag)
            if tag not in INLINE or any(d or t not in INLINE for t, d, _ in self.stack[at:]):
                self.flush()
            self.pop(at)
        elif tag == "p":
            self.flush()

    def handle_data(self, data):
        self.text.append(data)
        if self.open["a"] and not any(self.open[h] for h in HEADINGS):
            self.linked += len(data)

    def parse_marked_section(self, i, report=1):
        """A declaration that the parser gives up on ends at its bracket, and the page goes on."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1

    def done(self):
        self.flush()
        self.pop(0)
        self.end[0] = len(self.lines)
        self.judge()

    def judge(self):
        """Doubtful elements are content where nearly all of the page's paragraphs are theirs, and, if it has an article, within it or around it."""
        held, total = Counter(), 0
        for line in self.lines:
            if line.kept and line.prose:
                size = len(line.text) - line.linked
                held.update(dict.fromkeys(line.doubts, size))
                total += size
        inside = lambda a, b: self.begin[b] <= self.begin[a] and self.end[a] <= self.end[b]
        good = {e for e, n in held.items() if n >= LEAST and n > TIMES * (total - n) and (not self.whole or any(inside(e, w) or inside(w, e) for w in self.whole))}
        self.lines = [line._replace(kept=line.kept and good.issuperset(line.doubts)) for line in self.lines]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters on a line."""
    low, high = values.min(), values.max()
    for _ in range(20):
        cut = (low + high) / 2
        above = values > cut
        if above.all() or not above.any():
            break
        low, high = values[~above].mean(), values[above].mean()
    return (low + high) / 2


def _region(page: _Lines, high: np.ndarray) -> int:
    """The innermost element with nearly all text of the higher cluster, grown to its article and to parents that add only content."""
    mass = np.zeros(len(page.parent), np.int64)
    for line, chosen in zip(page.lines, high):
        if line.kept and chosen:
            mass[line.element] += len(line.text)
    for e in range(len(mass) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
    # An element that holds the share has no sibling that does, so the one of largest number is the innermost.
    at = int(np.flatnonzero(mass >= SHARE * mass[0])[-1])
    up = at
    while up:
        if up in page.whole:
            return up
        up = page.parent[up]
    while at:
        up = page.parent[at]
        others = [*range(page.begin[up], page.begin[at]), *range(page.end[at], page.end[up])]
        if not all(page.lines[i].kept and (high[i] or page.lines[i].prose and up in (page.lines[i].element, page.parent[page.lines[i].element])) for i in others):
            break
        at = up
    return at


def _menus(page: _Lines, high: np.ndarray, region: int) -> set[int]:
    """Lines inside the region of elements that hold no line of the higher cluster and more links than other text."""
    size, linked, best = (np.zeros(len(page.parent), np.int64) for _ in range(3))
    for line, chosen in zip(page.lines, high):
        size[line.element] += len(line.text)
        linked[line.element] += line.linked
        best[line.element] += bool(chosen)
    for e in range(len(size) - 1, 0, -1):
        for total in (size, linked, best):
            total[page.parent[e]] += total[e]
    gone, until = set(), -1
    for e in range(region + 1, len(size)):
        inside = page.begin[region] <= page.begin[e] and page.end[e] <= page.end[region]
        if inside and page.begin[e] >= until and page.tag[e] not in PROSE and not best[e] and 2 * linked[e] > size[e]:
            gone.update(range(page.begin[e], page.end[e]))
            until = page.end[e]
    return gone


def main_text(html: str | None) -> str:
    """The content lines of a page, one block a line."""
    page = _Lines()
    try:
        page.feed(html or "")
        page.close()
    except AssertionError:  # the parser gives up on some declarations
        pass
    page.done()
    if not any(line.kept for line in page.lines):
        return ""
    ratios = np.array([max(0, len(line.text) - line.linked) / line.tags if line.kept else 0.0 for line in page.lines])
    level = smoothed(np.log1p(ratios))
    high = level >= threshold(level)
    region = _region(page, high)
    gone = _menus(page, high, region)
    return "\n".join(page.lines[i].text for i in [*_title(page, region), *range(page.begin[region], page.end[region])] if page.lines[i].kept and i not in gone)


def _title(page: _Lines, region: int) -> list[int]:
    """The title of an article that has none itself: the h1 before it in the main or article around it."""
    is_title = lambda i: page.tag[page.lines[i].element] == "h1"
    around = page.parent[region]
    while around and around not in page.whole:
        around = page.parent[around]
    if region not in page.whole or not around or any(map(is_title, range(page.begin[region], page.end[region]))):
        return []
    return [i for i in range(page.begin[around], page.begin[region]) if is_title(i)]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
