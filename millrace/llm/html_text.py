"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page.  Lines of menus, headers,
footers, sidebars, notices, adverts, forms, comments and hidden parts are known by
their markup and are taken out; where a page marks articles, so is what stands
outside them.  A class or id leaves out no element that holds the only headline,
most of the text (comments, adverts and notices apart) or all of it.

The text lengths of the lines that remain are summed over a sliding window.  A line
that is mostly links weighs nothing, unless it is a heading or a paragraph of one
link.  Where the sum rises from nothing the text surges, where it falls to nothing it
dives, and every line between a surge and its dive is kept, links among them.  Thus
only link lines are ever left to the sums: those before the first text, those after
the last, and from the first to the last line of as many in a row as the window has.
No line of text is too short to count, and a page may hold any number of stretches.
If nothing weighs anything in a marked article, its links are its text.

NULL, empty and text-free pages give an empty text.  Tags that are never closed
end with the element around them, and with the page at the latest.  Time and memory
follow the length of a page, however deep its elements are nested.  Repeated rows
are pages of their own.  Columns ``text`` and ``n_chars`` of the input are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import add_columns

# Lines that are summed; so many lines of links end a stretch.
WINDOW = 5
# Share of a line's text in links above which it counts as a menu.
LINK_SHARE = 0.6

_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl "
    "dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend "
    "li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead "
    "title tr ul".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_DROPPED = frozenset(
    "nav footer aside form menu dialog head title button select textarea option label fieldset "
    "iframe object canvas svg math noscript noframes template audio video map datalist".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# One link that fills one of these is text too.
_PARAGRAPHS = frozenset("blockquote caption dd figcaption p pre".split()) | _HEADINGS
_RAW = "script|style|xmp|noembed"
_ARTICLE = frozenset(("article", "main"))
# Where these begin, an unclosed paragraph or entry of the same kind ends.
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_PART = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*+[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_HIDDEN = re.compile(
    r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden",
    re.I,
)
_SIDE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|"
    r"promotions?|banners?|cookies?|consent|gdpr|notices?|popups?|modals?|overlays?|nav|navs|"
    r"navbar|navigation|menus?|menubar|breadcrumbs?|sidebars?|complementary|contentinfo|search|"
    r"widgets?|related|recommend(?:ed|ations?)?|shares?|sharing|social|newsletters?|subscribe|"
    r"subscription|signup|login|footers?|headers?|masthead|comments?|commentlist|disqus|replies|"
    r"reply|respond|pagination|pager|toolbars?|copyright|legal|disclaimers?|skip)(?:$|[-_\s])",
    re.I,
)

# Of these, most of the text may well be under one.
_EXTRA = re.compile(
    r"(?:^|[-_\s])(?:comments?|commentlist|disqus|replies|reply|respond|ads?|adverts?|"
    r"advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|"
    r"consent|gdpr|popups?|modals?|overlays?|newsletters?|subscribe|subscription)(?:$|[-_\s])",
    re.I,
)
# Says what is beside or in an element, not what it is.
_BESIDE = re.compile(r"(?<!\S)(?:has|with|no|without)[-_]\S*", re.I)


@dataclass
class _Open:
    name: str
    dropped: bool
    article: bool
    by_class: bool
    # Number of an element that only its class or id leaves out.
    side: int = 0


@dataclass
class _Side:
    """An element that only its class or id leaves out; 0 stands for none."""

    parent: int
    extra: bool


@dataclass
class _Line:
    text: str
    dropped: bool
    menu: bool
    inside: bool
    headline: bool
    # The innermost such element around the line.
    side: int


class _Lines:
    """Lines of a page: text, whether it may count, what it stands in."""

    def __init__(self):
        self.lines: list[_Line] = []
        self.sides = [_Side(0, False)]
        self._parts: list[str] = []
        self._linked = 0
        # Number of the last link, and of those that have text in the line.
        self._link = 0
        self._line_links: set[int] = set()
        self._open: list[_Open] = []
        # How many elements of a name are open, and how many that keep what is in them out.
        self._named: Counter[str] = Counter()
        self._paragraphs = 0
        self._dropped = 0
        self._by_markup = 0
        self._firm = 0
        self._articles = 0
        self._inner = [0]

    def text(self, part: str) -> None:
        if part:
            self._parts.append(part)
            if self._named["a"] and (length := len(part.strip())):
                self._linked += length
                self._line_links.add(self._link)

    def end_line(self) -> None:
        if not self._parts:
            return
        line = " ".join(html.unescape("".join(self._parts)).split())
        if line:
            links = self._linked > LINK_SHARE * len(line)
            self.lines.append(
                _Line(
                    line,
                    self._by_markup > 0,
                    links and not (self._paragraphs and len(self._line_links) == 1),
                    self._articles > 0,
                    self._named["h1"] > 0,
                    self._inner[-1],
                )
            )
        self._parts, self._linked, self._line_links = [], 0, set()

    def open(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            self.end_line()
        if name in _VOID:
            return
        if name in _SELF_CLOSING and self._open and self._open[-1].name == name:
            self._pop()
        article = name in _ARTICLE
        by_class = hidden = False
        names = ""
        if attributes and name not in ("html", "body"):
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
            names = _BESIDE.sub("", names)
            hidden = bool(_HIDDEN.search(attributes))
            by_class = hidden or bool(names and _SIDE.search(names))
        if article and not by_class and self._dropped:
            # A container that merely names a sidebar, or was never closed.
            while self._dropped and self._open and self._open[-1].by_class:
                self._pop()
            if self._dropped and self._firm:
                while self._dropped:
                    self._pop()
        header = name == "header" and not self._articles
        dropped = by_class or header or name in _DROPPED
        side = 0
        if by_class and not (hidden or header or name in _DROPPED):
            side = len(self.sides)
            self.sides.append(_Side(self._inner[-1], bool(_EXTRA.search(names))))
        self._link += name == "a"
        self._push(
            _Open(name, dropped, article and not by_class and not self._dropped, by_class, side)
        )

    def close(self, name: str) -> None:
        if name in _BLOCKS:
            self.end_line()
        if self._named[name]:
            while self._pop().name != name:
                pass

    def _push(self, element: _Open) -> None:
        self._open.append(element)
        self._count(element, 1)
        if element.side:
            self._inner.append(element.side)

    def _pop(self) -> _Open:
        element = self._open[-1]
        if element.dropped or element.article:
            self.end_line()
        self._open.pop()
        self._count(element, -1)
        if element.side:
            self._inner.pop()
        return element

    def _count(self, element: _Open, by: int) -> None:
        self._named[element.name] += by
        self._paragraphs += by * (element.name in _PARAGRAPHS)
        self._dropped += by * element.dropped
        self._by_markup += by * (element.dropped and not element.side)
        self._firm += by * (element.dropped and element.name in ("nav", "head"))
        self._articles += by * element.article


def page_lines(page: str) -> tuple[list[_Line], list[_Side]]:
    """Lines of a page, and its elements that only their class or id leaves out."""
    lines, at = _Lines(), 0
    for part in _PART.finditer(page):
        lines.text(page[at : part.start()])
        at = part.end()
        if part[3]:
            name = part[3].lower()
            if part[2]:
                lines.close(name)
            else:
                lines.open(name, part[4])
    lines.text(page[at:])
    lines.end_line()
    return lines.lines, lines.sides


def _kept(lines: list[_Line], sides: list[_Side]) -> list[_Line]:
    """Lines that no class or id leaves out."""
    total = sum(len(line.text) for line in lines)
    headline = any(line.headline and not line.side for line in lines)
    held, heads = [0] * len(sides), [False] * len(sides)
    for line in lines:
        held[line.side] += len(line.text)
        heads[line.side] |= line.headline and not headline
    # An element comes after the one around it.
    for number in range(len(sides) - 1, 0, -1):
        held[sides[number].parent] += held[number]
        heads[sides[number].parent] |= heads[number]
    spared = [True] * len(sides)
    for number in range(1, len(sides)):
        most = 2 * held[number] > total and not sides[number].extra
        spared[number] = spared[sides[number].parent] and (heads[number] or most)
    return [line for line in lines if spared[line.side]] or lines


def stretches(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Each surge and its dive: first line of weight, line after the last one."""
    if not any(lengths):
        return []
    sizes = np.asarray(lengths, dtype=np.int64)
    summed = np.convolve(sizes, np.ones(window, dtype=np.int64))  # of the window's lines up to here
    flowing = np.concatenate(([0], (summed > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(flowing))
    # The sum falls to nothing when the last line of weight leaves the window.
    return [(int(a), int(b) - window + 1) for a, b in zip(edges[::2], edges[1::2])]


def main_text(page: str | None) -> str:
    """The article of a page, one line per block."""
    lines, sides = page_lines(page or "")
    lines = [line for line in lines if not line.dropped]
    marked = [line for line in lines if line.inside]
    found = _kept(marked or lines, sides)
    between = stretches([0 if line.menu else len(line.text) for line in found])
    if marked and not between:
        between = [(0, len(found))]
    return "\n".join(line.text for first, end in between for line in found[first:end])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points)."""

    def task():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [main_text(page) for page in batch.column(html_col).to_pylist()]
            # A reference may stand for half of a surrogate pair, which is no character.
            texts = [text.encode("utf-8", "replace").decode() for text in texts]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return add_columns(pages, "text string, n_chars bigint", task)
