"""Main text of web pages by line-block distribution (operator 2).

Markup is stripped into lines, one per block element; containers that are named or classed as
menu, header, footer, sidebar, notice, advert, form or comments leave as many blank lines as
they have blocks. Over windows of three lines the lengths of text outside links are summed. A surge to
``SURGE`` characters opens a region, a dive to nothing closes it; the lines between are the
article, whatever their own length. Lines beside it (a title before a menu, a last paragraph
after a form) stay too if they have the same parent container as a line of it. Where the page marks its article (article, main), only
lines inside count, and any length is a surge.

Defined cases: null or empty html, and a page without text, give the empty text; repeated
rows are treated alike; unclosed and crossed tags are tolerated: as in HTML, the start of a
block ends an open p, li, td or dd, and an end tag ends all that is open inside; a tag without ">"
ends at the next "<"; scripts and other raw text end at their own end tag and nowhere else; an empty table gives no rows;
other columns are ignored. Pages are read whole, one at a time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerwatch.llm.frames import per_slice

WINDOW = 3
SURGE = 80

# A quote opens a value only after "="; an unquoted value may hold quotes. A tag that is not closed before the next "<" ends there,
# so every "<" is looked at once, however broken the page.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|(<!\[CDATA\[)|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>][^\s<>]*)|[^<>=]++|=)*+)>?|<[!?][^>]*>?""", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile("[a-z]+")

_RAW = set("script style noscript template title textarea select svg math iframe object canvas audio video".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_SKIP = set("nav aside footer form button dialog menu search fieldset".split())
_BAD = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar sidebar aside rail widget widgets notice notices alert cookie cookies "
    "consent gdpr banner disclaimer ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion form search login signup "
    "newsletter subscribe subscription comment comments disqus respond replies discussion related recommended share sharing social pagination pager popup modal overlay".split()
)
_BAD_INSIDE = _BAD - {"header", "form", "search", "discussion", "alert", "banner", "foot", "rail"}
_GOOD = set("article content main body post entry story text page wrapper container layout with has".split())
# an end tag or an implied end reaches no further out than these
_TABLE = set("table tr td th thead tbody tfoot caption".split())
_ENDS_P = _BLOCKS - _TABLE - {"body", "html", "legend", "option"} | {"table", "form", "nav", "aside", "fieldset", "search"}
_PARENTS = set("article center details div main section td th".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_ENDED_BY = {
    "li": ({"li"}, (_BLOCKS | _SKIP) - {"li", "address", "div", "p"}),
    **dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, (_BLOCKS | _SKIP) - {"dd", "dt", "address", "div", "p"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})),
    "tr": ({"tr", "caption"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"})),
}
_COMMENTS = set("comment comments disqus respond replies".split())


def _names(attributes: str) -> set[str]:
    out: set[str] = set()
    for m in _NAMES.finditer(attributes):
        out.update(_WORD.findall((m[1] or m[2] or m[3] or "").lower()))
    return out


@lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I)


class _Scan:
    """Tags and comments of a page in order, each with the text before it."""

    def __init__(self, page: str):
        self.page, self.at, self.last_cdata = page, 0, page.rfind("]]>")

    def __iter__(self) -> Iterator[tuple[str, str | None, str, bool, str]]:
        """Text before, marked-up text (CDATA) or None, name ("" where it is no tag), whether an end tag, attributes."""
        while m := _TAG.search(self.page, self.at):
            text, self.at, inner = self.page[self.at : m.start()], m.end(), None
            if m[1]:
                close = self.page.find("]]>", self.at) if self.at <= self.last_cdata else -1
                if close >= 0:
                    inner, self.at = self.page[self.at : close], close + 3
                else:
                    self.at = self.page.find(">", self.at) + 1 or len(self.page)
            yield text, inner, (m[3] or "").lower(), bool(m[2]), m[4] or ""

    def past(self, name: str) -> None:
        """Goes on behind the end tag of ``name``; what is before it is no markup. Without one, the page ends."""
        m = _end_of(name).search(self.page, self.at)
        self.at = m.end() if m else len(self.page)


class _Open:
    """Names of the open block elements, outermost first."""

    def __init__(self):
        self.names: list[str] = []
        self.numbers: list[int] = []
        self.around: list[tuple[int, int]] = []  # place and number of those that are containers
        self.started = 0
        self.count: Counter[str] = Counter()

    def parents(self) -> frozenset[int]:
        """The container around the innermost block (0: the page), and that block if it is one itself."""
        inner = [n for _, n in self.around[-2:]]
        if self.around and self.around[-1][0] == len(self.names) - 1:
            return frozenset(inner if len(inner) == 2 else [*inner, 0])
        return frozenset(inner[-1:] or [0])

    def start(self, name: str) -> None:
        self.started += 1
        self.names.append(name)
        self.numbers.append(self.started)
        if name in _PARENTS:
            self.around.append((len(self.names) - 1, self.started))
        self.count[name] += 1

    def _back(self, wanted: set[str], bounds: set[str]) -> None:
        """Closes the innermost of ``wanted`` that is not outside of ``bounds``."""
        if not any(self.count[x] for x in wanted):
            return
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in wanted:
                self.count.subtract(self.names[i:])
                del self.names[i:], self.numbers[i:]
                while self.around and self.around[-1][0] >= i:
                    self.around.pop()
                return
            if self.names[i] in bounds:
                return

    def implied(self, name: str) -> None:
        """Closes what the start of ``name`` ends."""
        if name in _ENDS_P:
            self._back({"p"}, {"table", "td", "th", "caption", "button"})
        if name in _HEADINGS and self.names and self.names[-1] in _HEADINGS:
            self._back(_HEADINGS, set())
        if name in ("thead", "tbody", "tfoot"):
            self._back({"thead", "tbody", "tfoot"}, {"table"})
        if name in _ENDED_BY:
            self._back(*_ENDED_BY[name])

    def end(self, name: str) -> None:
        bounds = {"table"} if name in _TABLE else {"td", "th", "caption", "table", "ul", "ol", "menu"} if name == "li" else {"td", "th", "caption", "table"}
        self._back(_HEADINGS if name in _HEADINGS else {name}, bounds)


class _Lines:
    """Lines of a page: text, length outside links, whether the article holds the line, and its parents."""

    def __init__(self):
        self.parts: list[str] = []
        self.linked = 0
        self.parents: frozenset[int] | None = None
        self.out: list[tuple[str, int, bool, frozenset[int]]] = []

    def add(self, text: str, link: bool, opened: _Open) -> None:
        if self.parents is None and not text.isspace():
            self.parents = opened.parents()
        if link:
            self.linked += len(text.strip())
        self.parts.append(text)

    def end(self, inside: bool) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((text, max(len(text) - self.linked, 0), inside, self.parents or frozenset()))
        self.parts, self.linked, self.parents = [], 0, None

    def gap(self, n: int) -> None:
        self.out += [("", 0, False, frozenset())] * min(n, WINDOW)


def page_lines(page: str) -> list[tuple[str, int, bool, frozenset[int]]]:
    lines, scan = _Lines(), _Scan(page)
    link = article = 0  # open links, open articles
    opened = _Open()
    skipped, level, in_comments, blocks = "", 0, False, 0  # name of the skipped container, and elements open around it
    for text, inner, name, closing, attributes in scan:
        if text and not skipped:
            lines.add(html.unescape(text), link > 0, opened)
        if inner is not None and not skipped:
            lines.add(inner, link > 0, opened)
        if not name:
            continue
        empty = name in _VOID or attributes.endswith("/")
        known = name in _BLOCKS or name in _SKIP or name == skipped
        if known and closing:
            opened.end(name)
        elif known:
            opened.implied(name)
        if skipped:
            if len(opened.names) <= level:  # by its own end tag, that of an ancestor, or the start of the next block
                own = closing and name == skipped and len(opened.names) == level
                skipped, in_comments = "", False
                lines.gap(blocks)
                if own:
                    continue
            elif not closing and name in ("article", "main") and not in_comments and not _names(attributes) & _BAD_INSIDE:
                skipped = ""  # a container that was left open, or wraps the page
                lines.gap(WINDOW)
            else:
                if known and not closing and not empty:
                    opened.start(name)
                blocks += name in _BLOCKS and not closing
                if name in ("script", "style") and not closing and not empty:
                    scan.past(name)
                continue
        if name in _RAW and not closing and not empty:
            scan.past(name)
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            lines.add(" ", False, opened)
            continue
        if name not in _BLOCKS and name not in _SKIP and "=" not in attributes:
            continue
        if not closing and not empty and name not in ("html", "body"):
            names = _names(attributes) if "=" in attributes else set()
            bad = names & (_BAD_INSIDE if article else _BAD) if names and not (names & _GOOD and not names & _COMMENTS) else set()
            plain = name in _SKIP or name == "header" and not article
            if (plain or bad or _HIDDEN.search(attributes)) and not (name in ("article", "main") and not bad):
                lines.end(article > 0)
                skipped, level, in_comments, link, blocks = name, len(opened.names), bool(names & _COMMENTS), 0, 1
                opened.start(name)
                continue
            if known:
                opened.start(name)
        if name in ("article", "main"):
            lines.end(article > 0)
            article = max(article + (-1 if closing else 1), 0)
            link = 0
        elif name in _BLOCKS:
            lines.end(article > 0)
            link = 0
    if not skipped:
        lines.add(html.unescape(page[scan.at :]), link > 0, opened)
    lines.end(article > 0)
    return lines.out


def regions(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """Line ranges between surge and dive points of the window sums."""
    n, out, start = len(lengths), [], -1
    padded = lengths + [0] * WINDOW
    for i in range(n + 1):
        block = sum(padded[i : i + WINDOW]) if i < n else 0
        if start < 0 and block > 0:
            start, peak = i, 0
        if start >= 0:
            peak = max(peak, block)
            if block == 0:
                if peak >= surge:
                    out.append((start, i))
                start = -1
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    lines = page_lines(page or "")
    marked = any(inside and text for text, _, inside, _ in lines)
    if marked:  # lines of links only inside a marked article are its own
        lengths = [len(text) if inside else 0 for text, _, inside, _ in lines]
        found = regions(lengths, 1)
    else:
        lengths = [n for _, n, _, _ in lines]
        found = regions(lengths, SURGE)
        if not found:
            found = sorted(regions(lengths, 1), key=lambda r: -sum(lengths[r[0] : r[1]]))[:1]
    chosen = [False] * len(lines)
    for a, b in found:
        while a < b and not lengths[a]:
            a += 1
        chosen[a:b] = [inside or not marked for _, _, inside, _ in lines[a:b]]
    if not marked:
        around = frozenset().union(*(parents for (_, n, _, parents), c in zip(lines, chosen, strict=True) if c and n))
        chosen = [c or n > 0 and not around.isdisjoint(parents) for (_, n, _, parents), c in zip(lines, chosen, strict=True)]
    return "\n".join(text for (text, *_), c in zip(lines, chosen, strict=True) if c and text)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    slim = pages.select(pages[key], pages[url], pages[source].cast("string").alias("_html"))
    kinds = [f.dataType.simpleString() for f in slim.schema[:2]]
    return slim.mapInArrow(per_slice(work, "_html"), f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars bigint")
