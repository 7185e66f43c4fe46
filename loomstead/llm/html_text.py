"""Main text of raw pages by line-block distribution.

One path for all pages.

1. Markup is stripped to lines, one for each block.  Menus, headers, footers,
   sidebars, notices, adverts, forms and comments, known by their tags or class
   names, become empty lines, wherever they stand.
2. Each line weighs its text: link text does not count, and on a page that marks
   its article (``article`` or ``main``) lines outside of it weigh nothing while
   inside of it link text counts too.
3. The weights are summed over a sliding window.  The text surges where the sum
   rises above a threshold, and from there reaches to the dive points on both
   sides, where a whole window weighs nothing.  The threshold is ``THRESHOLD``, or
   half of the page's highest sum where that is less, so that short articles count.
4. The lines between are kept, of every span; lines that weigh nothing are cut
   off a span's ends, unless they are headings.

Defined results: null, empty and markup-only pages give an empty text; scripts,
styles and the like end at their own end tag only, and reach to the next
``body`` or ``article`` or the end where they have none; an element to be dropped
that is never closed reaches to the next ``article`` or ``main``, or else covers
its own line only; several articles are one text, in page order; every other
column is passed through by name only (page_id, url), so that extra columns
cannot clash; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

WINDOW = 3
THRESHOLD = 60

_OPAQUE = re.compile(r"<!--|<(script|style|noscript|template|svg|iframe|head|textarea|select|option|object|canvas)\b[^>]*>|<[!?][^>]*>", re.I)
_NEXT = re.compile(r"<body\b|<article\b", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

_BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_DROPPED = frozenset("nav aside footer form menu button dialog title label input fieldset".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that end where the next block begins or the one around them ends.
_OPEN_ENDED = frozenset("p li dd dt td th tr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTENT = frozenset(("article", "main"))
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar comment comments disqus reply replies respond discussion "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager copyright legal tags complementary contentinfo".split()
)
#: Parts that a class name may have besides words of boilerplate: site-footer, comment-list; but not no-sidebar.
_QUALIFIERS = frozenset("site page main top bottom left right global primary secondary user reader post article entry list box area section wrapper container block bar item items link links slot unit text inner outer wrap row col form button".split())
_PART = re.compile(r"[-_]+")


def _boilerplate(attributes: str, inside: bool) -> bool:
    """Whether a class, id or role names boilerplate: as a whole name, or in all of its parts but qualifiers."""
    if "=" not in attributes:
        return False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = {name} if name in _BOILERPLATE else set(_PART.split(name.strip("-_")))
            found = words & _BOILERPLATE
            if found and words - found <= _QUALIFIERS and not (inside and found <= {"header", "masthead"}):
                return True
    return False


def without_hidden(page: str) -> str:
    """The page without comments, declarations, and elements whose content is no text."""
    out, at, ends = [], 0, {}
    while m := _OPAQUE.search(page, at):
        out.append(page[at : m.start()])
        name = m[0] if m[0] == "<!--" else (m[1] or "").lower()
        if not name:
            at = m.end()
            continue
        end = re.compile("-->") if name == "<!--" else re.compile(rf"</{name}\b[^>]*>", re.I)
        close = None if ends.get(name) == -1 else end.search(page, m.end())
        if close:
            at = close.end()
        else:  # nor is there an end for any later one
            ends[name] = -1
            rest = None if name == "<!--" or ends.get("<") == -1 else _NEXT.search(page, m.end())
            if rest is None and name != "<!--":
                ends["<"] = -1
            at = rest.start() if rest else len(page)
        out.append(" ")
    out.append(page[at:])
    return "".join(out)


def _matches(tags: list[re.Match[str]]) -> dict[int, int]:
    """For each start tag that has one, the number of its end tag; elements of one name nest."""
    open_: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for i, m in enumerate(tags):
        name = m[2].lower()
        if not m[1]:
            open_.setdefault(name, []).append(i)
        elif open_.get(name):
            out[open_[name].pop()] = i
    return out


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """A page's lines: text, length without links, whether in a marked article, whether a heading."""
    page = without_hidden(page)
    tags = list(_TAG.finditer(page))
    ends = _matches(tags)
    contents = [i for i, m in enumerate(tags) if not m[1] and m[2].lower() in _CONTENT]
    lines: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    linked = in_link = inside = next_content = at = 0
    heading = False

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                lines.append((line, max(0, len(line) - linked), inside > 0, heading))
        text.clear()
        linked = 0

    def dropped_to(i: int, name: str) -> int:
        """The number of the first tag after the element that begins with tag ``i``."""
        if name in _OPEN_ENDED:
            j = i + 1
            while j < len(tags) and tags[j][2].lower() not in _BLOCKS:
                j += 1
            return j + 1 if j < len(tags) and tags[j][1] and tags[j][2].lower() == name else j
        if i in ends:
            return ends[i] + 1
        if next_content < len(contents):
            return contents[next_content]
        j = i + 1
        while j < len(tags) and tags[j][2].lower() not in _BLOCKS:
            j += 1
        return j

    i = 0
    while i < len(tags):
        m = tags[i]
        between, at = page[at : m.start()], m.end()
        closing, name = m[1], m[2].lower()
        if between:
            text.append(between)
            if in_link:
                linked += len(html.unescape(between).strip())
        while next_content < len(contents) and contents[next_content] <= i:
            next_content += 1
        if name in _BLOCKS:
            flush()
        elif not closing and name == "img":
            text.append(" ")
        i += 1
        if closing:
            if name == "a":
                in_link = 0
            elif name in _CONTENT:
                inside = max(0, inside - 1)
            elif name in _HEADINGS:
                heading = False
        elif name in _CONTENT:
            if _boilerplate(m[3], True) and i - 1 in ends:
                lines.append(("", 0, inside > 0, False))
                i = ends[i - 1] + 1
                at = tags[i - 1].end()
            else:
                inside += 1
        elif name not in _VOID and name not in ("body", "html") and (name in _DROPPED or (name == "header" and not inside) or _boilerplate(m[3], inside > 0)):
            flush()
            lines.append(("", 0, inside > 0, False))
            j = dropped_to(i - 1, name)
            in_link, heading = 0, False
            # Text after an end tag is the page's again; text before any other tag is still of the element.
            at = tags[j - 1].end() if j > i and tags[j - 1][1] and (j - 1 == ends.get(i - 1) or name in _OPEN_ENDED) else tags[j].start() if j < len(tags) else len(page)
            i = j
        elif name == "a":
            in_link = 1
        elif name in _HEADINGS:
            heading = True
        elif name == "p":
            in_link, heading = 0, False
    text.append(page[at:])
    flush()
    return lines


def weights(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    """What each line weighs in the distribution."""
    marked = any(x[2] and x[0] for x in lines)
    return [(len(x[0]) if x[2] else 0) if marked else x[1] for x in lines]


def sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """The distribution: weights summed over the window around each line."""
    half, n, out = window // 2, len(weights), []
    total = sum(weights[:half])
    for i in range(n):
        total += (weights[i + half] if i + half < n else 0) - (weights[i - half - 1] if i > half else 0)
        out.append(total)
    return out


def spans(weights: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """From dive point to dive point around each surge: runs of lines whose windows weigh something, one of them more than the threshold."""
    found = sums(weights, window)
    least = min(threshold, max(found, default=0) / 2)
    out, start = [], None
    for i, x in enumerate([*found, 0]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            if max(found[start:i]) > least:
                out.append((start, i))
            start = None
    return out


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD, marks: bool = True) -> str:
    """The main text of one page: its blocks in order, joined by a line feed.  Without ``marks`` article and main count as any block."""
    if not page:
        return ""
    lines = lines_of(page)
    if not marks:
        lines = [(x[0], x[1], False, x[3]) for x in lines]
    marked = any(x[2] and x[0] for x in lines)
    weight = weights(lines)
    kept: list[str] = []
    for a, b in spans(weight, window, threshold):
        while a < b and not weight[a] and not (lines[a][3] and not marked):
            a += 1
        while b > a and not weight[b - 1]:
            b -= 1
        kept += [x[0] for x in lines[a:b] if x[0] and (x[2] or not marked)]
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page; nothing is shuffled."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [main_text(x, window, threshold) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
