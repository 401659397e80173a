"""Main text of web pages by the distribution of text over their lines.

Markup is stripped to lines: a line is the text between two edges of blocks, in
page order. Each line weighs its code points outside links; a line of an element
that never holds the article (menus, forms, scripts, sidebars and so on, known by
tag, role or the words of class and id) keeps its place with weight 0. WINDOW
consecutive lines are summed from each line on. Where the sums surge over a
level, a stretch of main text begins, at its first line with weight; where they
dive below it, the stretch ends with its last line with weight before. Text
between surge and dive is kept.

Distribution alone can't tell a short last paragraph from a short footer, so a
stretch is then fitted to the element that holds it. That is the article or main
element around it; where a page marks none, it is found from the body down: of an
element's children, those at the stretch's ends with less than an eighth (LIGHT) of
the heaviest one's text are left off, as long as the heaviest has lines of its own,
and where one child is left, it is the next. All lines of the element found are
kept. Stretches inside an article are taken before those outside, heavier ones
before lighter; without an article, other stretches stay if they aren't light.

Defined results: a null, empty or textless page has an empty text; a page whose
lines all stay below LEVEL has its greatest window as the only stretch; an element that
class or id call a side matter counts as content if it holds more than half of the
page's weight and isn't comments, so that a site's odd names cost no article;
unclosed tags, comments and scripts end with the page. Rows with null ids or urls
and repeated rows are extracted each. The work is linear in a page's length.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, slices

#: Lines of a window, and code points that a window of main text has at least.
WINDOW, LEVEL = 3, 86
#: What has less than the heaviest one's weight over this is light.
LIGHT = 8

# Fixed values of HTML: elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre br".split())
CLOSES_P = BLOCK - frozenset("br body html head option optgroup td th tr tbody thead tfoot caption".split())
#: Elements whose text is never the article's.
ASIDE = frozenset("script style textarea title iframe xmp noembed noframes head nav footer aside noscript template button select option datalist dialog menu search svg canvas object audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert status tablist".split())
# Words of class and id by what they say of an element.
COMMENTS = frozenset("comment comments commentlist commentform commentarea commentsection commentbox commentthread disqus reply replies respond responses reactions discussion".split())
SIDE = COMMENTS | frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr
    notice notices notification notifications alert popup popover modal overlay newsletter subscribe subscription signup signin login paywall menu menus nav navbar navigation navi breadcrumb
    breadcrumbs sidebar sidebars aside widget widgets footer foot masthead topbar share sharing social related recommended recommendations trending toolbar pagination pager copyright
    disclaimer outbrain taboola skip adbox adbanner adunit adcontainer adwrapper leaderboard billboard topnav sidenav mainmenu submenu dropdown siteheader pageheader""".split()
)
#: Beginnings of such words, and the word for what is side matter only outside an article.
STEMS, HEADER = ("cookie", "sidebar", "advert", "newsletter", "sponsor", "breadcrumb", "navbar", "footer"), "header"
MAIN = frozenset("article articles entry post story main".split())

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
#: Names of what an element has, not of what it is.
_HAS = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


@dataclass
class Element:
    """An open element: its place in the page's tree, and what it says of the text in it."""

    tag: str
    number: int
    holder: int
    aside: int
    link: bool


@dataclass
class Line:
    """A block's pieces of text, and the elements they stand in."""

    holder: int
    aside: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _kind(tag: str, attributes: str, within: bool) -> tuple[bool, bool, bool]:
    """Whether an element is side matter for sure, is called so (as forms are, which may hold a whole page), and is called comments; ``within`` an article."""
    if tag in ASIDE:
        return True, False, False
    if tag == "header" and not within:
        return True, False, False
    if not attributes or attributes.isspace():
        return False, tag == "form", False
    got: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        got.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    if hidden or got.get("role", "").lower() in ROLES:
        return tag not in ("html", "body"), False, False
    words = {w.lower() for w in _WORD.findall(_HAS.sub(" ", f"{got.get('class', '')} {got.get('id', '')}"))}
    if tag in ("html", "body", "main"):
        return False, False, False
    comments = bool(words & COMMENTS)
    side = tag == "form" or bool(words & SIDE) or any(w.startswith(STEMS) for w in words) or (HEADER in words and not within)
    return False, comments or (side and (tag == "form" or not words & MAIN)), comments


class Page:
    """A page's lines, and the tree of the elements that hold them."""

    def __init__(self, source: str):
        self.lines: list[Line] = []
        #: By element that holds lines: its tag, its holder, what it holds, its lines (up to the last one's end), the
        #: outermost article and the outermost main around it, and whether it is side matter for sure.
        self.tag, self.parent, self.children, self.first, self.end = [""], [-1], [[]], [0], [0]
        self.article, self.main, self.sure = [0], [0], [False]
        self._open = [Element("", 0, 0, 0, False)]
        self._count: dict[str, int] = {}
        self._line: Line | None = None
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            self._text(source[at : m.start() if m else len(source)])
            if not m:
                break
            at = m.end()
            tag = m[2].lower() if m[2] else ""
            if not tag:
                continue
            if m[1]:
                self._close(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                self._text(source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
                self._close(tag)
        for e in self._open:
            self.end[e.holder] = len(self.lines)

    def _text(self, text: str) -> None:
        if not text:
            return
        top = self._open[-1]
        if self._line is None:
            if text.isspace():
                return
            self._line = Line(top.holder, top.aside)
            self.lines.append(self._line)
        elif self._line.aside != top.aside:  # an inline element may be side matter
            self._line = Line(top.holder, top.aside)
            self.lines.append(self._line)
        text = entities.unescape(text) if "&" in text else text
        self._line.pieces.append(text)
        if top.link:
            self._line.linked += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._line = None
        if tag in CLOSES_P and self._count.get("p"):
            self._close("p")
        for same, until in ((("li",), ("ul", "ol", "menu", "dir")), (("dt", "dd"), ("dl",)), (("option",), ("select",)), (("td", "th"), ("tr", "table")), (("tr",), ("table", "tbody", "thead", "tfoot"))):
            if tag in same:
                for other in same:
                    if self._count.get(other) and self._above(other, until):
                        self._close(other)
        if tag in VOID:
            return
        top = self._open[-1]
        number, aside = top.holder, top.aside
        sure, named, comments = _kind(tag, attributes, bool(self.article[number] or self.main[number]))
        if tag in BLOCK or sure or named:
            number = len(self.parent)
            self.children[top.holder].append(number)
            own = 0 if sure or named else number
            for column, value in (
                (self.tag, tag),
                (self.parent, top.holder),
                (self.children, []),
                (self.first, len(self.lines)),
                (self.end, len(self.lines)),
                (self.article, self.article[top.holder] or (own if tag == "article" else 0)),
                (self.main, self.main[top.holder] or (own if tag == "main" else 0)),
                (self.sure, sure or comments),
            ):
                column.append(value)
            if (sure or named) and not (aside and self.sure[aside]):
                aside = number
        self._open.append(Element(tag, len(self._open), number, aside, top.link or tag == "a"))
        self._count[tag] = self._count.get(tag, 0) + 1

    def _above(self, tag: str, until: tuple[str, ...]) -> bool:
        """Whether an open ``tag`` stands above all of ``until``."""
        for e in reversed(self._open):
            if e.tag == tag:
                return True
            if e.tag in until:
                return False
        return False

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._line = None
        if not self._count.get(tag):
            return
        at = len(self._open) - 1
        while self._open[at].tag != tag:
            if tag not in BLOCK and self._open[at].tag in BLOCK:
                return  # an inline end tag closes no block
            at -= 1
        if self._open[-1].aside != self._open[at - 1].aside:
            self._line = None
        for e in self._open[at:]:
            self._count[e.tag] -= 1
            if e.holder != self._open[at - 1].holder:
                self.end[e.holder] = len(self.lines)
        del self._open[at:]

    def units(self, element: int, first: int, end: int) -> list[tuple[int, int, int]]:
        """What an element holds of these lines, in order: (element, first, end) of what it holds, (0, ...) for a line of its own."""
        out, at = [], first
        inner = self.children[element]
        for c in inner[max(0, bisect_right(inner, first, key=self.first.__getitem__) - 1) :]:
            if self.first[c] >= end:
                break
            if self.end[c] <= at:
                continue
            out += [(0, i, i + 1) for i in range(at, self.first[c])]
            at = min(end, self.end[c])
            out.append((c, max(first, self.first[c]), at))
        return out + [(0, i, i + 1) for i in range(at, end)]


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """Where the distribution of weights surges and dives: first and last lines of the stretches between."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    out: list[tuple[int, int]] = []
    level = LEVEL
    if max(sums, default=0) < LEVEL:
        top = max(range(len(sums)), key=lambda i: (sums[i], -i), default=0)
        there = [i for i in range(top, min(top + WINDOW, len(weights))) if weights[i]]
        return [(there[0], there[-1])] if there else out
    i = 0
    while i < len(sums):
        if sums[i] < level:
            i += 1
            continue
        # Surge: lines of the window before its weight aren't the text's.
        start = i
        while not weights[start]:
            start += 1
        last = start
        end = start
        # Dive: a line whose window is below the level; the window before it reaches to the last line.
        while end < len(sums) and sums[end] >= level:
            if weights[end]:
                last = end
            end += 1
        out.append((start, last))
        i = max(end, start + 1)
    return out


def _weigh(page: Page, texts: list[str]) -> tuple[list[int], list[bool]]:
    """Code points outside links of each line, 0 for side matter; and which lines may be shown: no side matter, and no run of WINDOW links."""
    plain = [max(0, len(t) - line.linked) for t, line in zip(texts, page.lines, strict=True)]
    whole = sum(p for p, line in zip(plain, page.lines, strict=True) if not page.sure[line.aside])
    by_aside: dict[int, int] = {}
    for p, line in zip(plain, page.lines, strict=True):
        by_aside[line.aside] = by_aside.get(line.aside, 0) + p
    # Side matter by its names alone, though most of a page that marks no article of its own.
    marked = any(page.article[line.holder] or page.main[line.holder] for p, line in zip(plain, page.lines, strict=True) if p and not line.aside)
    content = {a for a, n in by_aside.items() if not a or (not marked and not page.sure[a] and 2 * n > whole)}
    shown = [bool(t) and line.aside in content for t, line in zip(texts, page.lines, strict=True)]
    weights = [p if s else 0 for p, s in zip(plain, shown, strict=True)]
    start = 0
    for i in range(len(shown) + 1):
        if i == len(shown) or weights[i] or not shown[i]:
            if i - start >= WINDOW:
                shown[start:i] = [False] * (i - start)
            start = i + 1
    return weights, shown


def main_text(source: str | None) -> str:
    """The text between surge and dive, widened to the element that holds it."""
    if not source:
        return ""
    page = Page(source)
    texts = [line.text() for line in page.lines]
    weights, shown = _weigh(page, texts)
    found = stretches(weights)
    if not found:
        return ""
    upto = [0, *accumulate(weights)]
    inside = lambda e: upto[page.end[e]] - upto[page.first[e]]
    marks = [_mark(page, line.holder, inside) if w else 0 for line, w in zip(page.lines, weights, strict=True)]
    marked = [0, *accumulate(map(bool, marks))]
    best = max(found, key=lambda s: (marked[s[1] + 1] > marked[s[0]], upto[s[1] + 1] - upto[s[0]]))
    homes = {m for m in marks[best[0] : best[1] + 1] if m}
    if homes:
        home = max(homes, key=lambda h: (inside(h), -h))
        kept = set(range(page.first[home], page.end[home]))
    else:
        least, kept = (upto[best[1] + 1] - upto[best[0]]) / LIGHT, set()
        for a, b in found:
            if (a, b) == best or upto[b + 1] - upto[a] >= least:
                kept.update(range(*_fitted(page, a, b + 1, upto)))
    return " ".join(texts[i] for i in sorted(kept) if shown[i])


def _mark(page: Page, holder: int, inside) -> int:
    """The article around a line, or the main element where the article has less than half of its text; 0 if there is neither."""
    article, main = page.article[holder], page.main[holder]
    return main if not article or (main and main < article and 2 * inside(article) < inside(main)) else article


def _fitted(page: Page, first: int, end: int, upto: list[int]) -> tuple[int, int]:
    """A stretch without light elements at its ends, widened to the element that is left."""
    element = 0
    while True:
        units = [u for u in page.units(element, first, end) if upto[u[2]] > upto[u[1]]]
        weight = [upto[b] - upto[a] for _, a, b in units]
        top = max(range(len(units)), key=lambda i: (weight[i], -i))
        child, a, b = units[top]
        if not child or b - a < 2:
            break  # its parts are lines: short ones among them are the text's
        low, high = 0, len(units)
        while weight[low] * LIGHT < weight[top]:
            low += 1
        while weight[high - 1] * LIGHT < weight[top]:
            high -= 1
        first, end = units[low][1], units[high - 1][2]
        if high - low > 1:
            break
        element = child
    if element and page.tag[element] not in ("html", "body"):
        return page.first[element], page.end[element]
    # In the body itself: over its own lines and paragraphs, but no further element with lines of its own.
    while first > 0 and _prose(page, first - 1, element):
        first -= 1
    while end < len(page.lines) and _prose(page, end, element):
        end += 1
    return first, end


def _prose(page: Page, line: int, element: int) -> bool:
    """Whether a line is the element's own, or that of a paragraph or heading in it."""
    holder = page.lines[line].holder
    return holder == element or (page.parent[holder] == element and page.tag[holder] in PROSE)


def _extract(batches):
    for batch in batches:
        for piece in slices(batch, "html"):
            texts = [main_text(h) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    return in_arrow(pages.selectExpr("cast(page_id as long) AS page_id", "cast(url as string) AS url", "cast(html as string) AS html"), _extract, "page_id long, url string, text string, n_chars long")
