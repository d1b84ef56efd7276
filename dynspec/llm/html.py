"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page. A line weighs what text it has outside links; lines of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, known by their elements and the words of class, id and role, weigh nothing and are left out wherever they stand. Weights are summed over sliding windows of
lines; a surge is where the sums rise to ``SURGE``, a dive where they fall to nothing, and the stretch between them with the most text is
the article's core. Its edges are then moved outwards over short lines that go on as the core does (headings before it, paragraphs, items and the like in the same container), and over
the ``article`` or ``main`` element that holds most of the core, if there is one: the density of text finds the article, markup says where it ends.

Scanning is linear in the page: nothing is searched for twice from the same place, open elements are kept on one stack, and sums come from running totals.

Defined results: a null page is the empty one, and a page without text gives the empty string; where no sum rises to ``SURGE``, the text is that of the ``article`` or ``main``, or else of all lines that are not left out;
an element left open lasts until the one around it
ends; an unclosed comment or script lasts to the end; white space of any kind within a block, ``br`` included, becomes one
space; repeated rows come back as often as they went in; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WINDOW = 3
SURGE = 40
HOLDS = 0.6

# Element names and the words in class, id and role that mark boilerplate or content.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
SKIPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog"}
BLOCKS = set(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar comments comment disqus reply replies respond share sharing social related recommended newsletter subscribe signup login search".split()
)
FLOW = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption summary caption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
KEPT_AROUND = {"html", "body", "article", "main"}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_MARK = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile(r"[a-z0-9]+")
_ENDS = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW}


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element's class, id and role say boilerplate, and whether its role says content."""
    bad = good = False
    for kind, value in _MARK.findall(attributes):
        words = set(_WORD.findall(value.lower()))
        if kind.lower() == "role":
            bad, good = bad or bool(words & BAD_ROLES), good or bool(words & {"main", "article"})
        else:
            bad = bad or bool(words & BAD_WORDS)
    return bad, good and not bad


class _Line(NamedTuple):
    text: str
    weight: int
    skip: bool
    block: str  # the element that holds it
    container: int  # what holds that


class _Page:
    """Lines of a page and the content elements around them."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.lines: list[_Line] = []
        self.held: list[list[int]] = []  # of each content element: its first line, the one after its last
        self.stack: list[tuple[str, bool, int, int]] = []
        self.opened = 0
        self.muted = 0  # open boilerplate elements within a line
        self.open: Counter = Counter()
        self.skips = 0
        self.link = False
        self.parts: list[str] = []
        self.plain = 0
        self.none_after = {'"': False, "'": False}
        self._scan()

    def _flush(self) -> None:
        if self.parts:
            joined = "".join(self.parts)
            text = " ".join((unescape(joined) if "&" in joined else joined).split())
            if text:
                skip = self.skips > 0
                self.lines.append(_Line(text, 0 if skip else self.plain, skip, self.stack[-1][0] if self.stack else "", self.stack[-2][3] if len(self.stack) > 1 else 0))
        self.parts, self.plain = [], 0

    def _add(self, text: str) -> None:
        if self.muted:
            return
        self.parts.append(text)
        if not self.link:
            self.plain += len(text.strip())

    def _pop(self) -> None:
        name, skip, held, _ = self.stack.pop()
        self.open[name] -= 1
        if name in BLOCKS or name in SKIPPED:
            self.skips -= skip
        else:
            self.muted -= skip
        if held >= 0:
            self.held[held][1] = len(self.lines)

    def _tag_end(self, at: int) -> int:
        """The place after the ``>`` of the tag that ``at`` is in; quoted ones do not count."""
        n = len(self.html)
        while m := _STOP.search(self.html, at):
            if m[0] == ">":
                return m.end()
            end = -1 if self.none_after[m[0]] else self.html.find(m[0], m.end())
            self.none_after[m[0]] |= end < 0
            at = m.end() if end < 0 else end + 1
        return n

    def _start(self, name: str, attributes: str, closed: bool) -> None:
        block = name in BLOCKS
        if block or name in SKIPPED:
            self._flush()
        if name == "a":
            self.link = True
        if name == "br":
            self._add(" ")
        if name in VOID or closed and not block:
            return
        bad, good = _marks(attributes) if attributes else (False, False)
        bad = (name in SKIPPED or name == "header" and not (self.open["article"] or self.open["main"]) or bad) and name not in KEPT_AROUND
        if name == "body":
            while self.stack and self.stack[-1][0] != "html":
                self._pop()
        if not block and not bad and name not in SKIPPED:
            return
        if block and self.stack and self.stack[-1][0] == "p":
            self._pop()
        held = -1
        if name in ("article", "main") and not bad or good and block and name != "body":
            held = len(self.held)
            self.held.append([len(self.lines), -1])
        self.opened += 1
        self.stack.append((name, bad, held, self.opened))
        self.open[name] += 1
        if block or name in SKIPPED:
            self.skips += bad
        else:
            self.muted += bad

    def _end(self, name: str) -> None:
        if name in BLOCKS or name in SKIPPED:
            self._flush()
        if name == "a":
            self.link = False
        if self.open[name]:
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()

    def _scan(self) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = html.find("<", at)
            if lt != at:
                self._add(html[at : lt if lt >= 0 else n])
                if lt < 0:
                    break
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            close = html.startswith("</", lt)
            name = _NAME.match(html, lt + 1 + close)
            if not name:
                if html.startswith(("<!", "<?"), lt) or close:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self._add("<")
                    at = lt + 1
                continue
            at = self._tag_end(name.end())
            tag = name[0].lower()
            if close:
                self._end(tag)
                continue
            attributes = html[name.end() : at - 1]
            if tag in RAW:
                if not attributes.endswith("/"):
                    end = _ENDS[tag].search(html, at)
                    at = self._tag_end(end.end()) if end else n
                continue
            self._start(tag, attributes, attributes.endswith("/"))
        self._flush()
        while self.stack:
            self._pop()


def _core(weights: list[int]) -> tuple[int, int]:
    """The lines between the surge and the dive around the most text: from the first line with text in a window whose sum reaches ``SURGE`` to the last before one whose sum is 0."""
    total = [0, *accumulate(weights)]
    n, best, most, i = len(weights), (0, 0), 0, 0
    window = lambda at: total[min(n, at + WINDOW)] - total[at]
    while i < n:
        if window(i) < SURGE:
            i += 1
            continue
        start = i
        while not weights[start]:
            start += 1
        while i < n and window(i):
            i += 1
        if total[i] - total[start] > most:
            most, best = total[i] - total[start], (start, i)
    return best


def main_text(html: str | None, elements: bool = True) -> str:
    """The main text of one page, its blocks joined by line ends. Without ``elements``, ``article`` and ``main`` count as any other block."""
    page = _Page(html or "")
    lines, total = page.lines, [0, *accumulate(x.weight for x in page.lines)]
    first, last = _core([x.weight for x in lines])
    core, within = total[last] - total[first], {x.container for x in lines[first:last] if x.weight}
    if core:
        while first and (lines[first - 1].skip or lines[first - 1].block in HEADINGS or lines[first - 1].block in FLOW and lines[first - 1].container in within):
            first -= 1
        while last < len(lines) and (lines[last].skip or lines[last].block in FLOW and lines[last].container in within):
            last += 1
    held = [(b - a, a, b) for a, b in page.held if total[max(a, min(b, last))] - total[min(b, max(a, first))] >= HOLDS * core and b > a] if elements else []
    if held:
        _, a, b = min(held) if core else max(held)
        first, last = (min(first, a), max(last, b)) if core else (a, b)
    elif not core:
        first, last = 0, len(lines)
    return "\n".join(x.text for x in lines[first:last] if not x.skip)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    id_kind, url_kind = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return rows.mapInArrow(run, f"page_id {id_kind}, url {url_kind}, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
