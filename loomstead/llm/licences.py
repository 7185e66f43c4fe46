"""Licence scans by patience alignment.

A licence text (template) and a document are aligned word by word.  Words that
occur once in both are anchors; the longest increasing subsequence of their
places in the document keeps those in order, and the gaps between them are
aligned in the same way.  Gaps without an anchor are closed by extending equal
words from their ends and, where words are left, by a longest common
subsequence.  Coverage is the share of the template's words that are aligned;
where alignment scatters over a long text, the densest stretch counts.

Alignment is local: only stretches of the text, of at most ``SPREAD`` times the
template's length, that hold enough of its words are aligned, each by itself,
so that the same words elsewhere and other copies of a notice cannot draw the
alignment apart.  All stretches that reach the limit are reported; of those that
overlap, the one with the most aligned words, then the highest coverage, then
the shortest stays.

Words that tell licences and versions apart, the keys of a template, must be
among the aligned ones: another licence's name in the same sentence is none.

Every document is compared with every template, whole; the templates are a
parameter of bounded size, so that the scan is one pass without a shuffle.  A
document that shares none of a template's words has coverage 0 without being
aligned.

Defined results: null, empty and blank texts have no licence; of templates with
equal coverage the longer one is named, then the one that stands first in the text; a
template of which no word is left after normalisation is ignored; repeated
rows give repeated results; an empty table gives no rows.  Only the id and text
columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship
from .licence_table import GENERIC, NOTICE_WORDS, Template, licence_table

COVERAGE = 0.8
#: A template word may lie among so many other words, on average, in the stretch that counts.
SPREAD = 2.0
MAX_TEMPLATE_WORDS = 200_000
#: Templates of at most so many words are aligned from each of their words in the text.
SHORT = 40

#: A few notices by SPDX identifier; ``licence_table`` has all that is looked for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
}

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Normalised words with their places in the text."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def increasing(places: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        pile = bisect_left(tops, x)
        before[i] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(x)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = x, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _subsequence(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of a gap, in linear space, by the places of a's words in b."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    pairs = [(i, j) for i, w in enumerate(a) for j in reversed(where.get(w, ()))]
    return [pairs[k] for k in increasing([j for _, j in pairs])]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned places of template ``a`` and text ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: j for j, w in enumerate(b[b0:b1], b0) if right[w] == 1 and left.get(w) == 1}
        anchors = [(i, once[w]) for i, w in enumerate(a[a0:a1], a0) if w in once]
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _subsequence(a[a0:a1], b[b0:b1])]
            continue
        at = (a0, b0)
        for k in increasing([j for _, j in anchors]):
            i, j = anchors[k]
            out.append((i, j))
            work.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
        work.append((at[0], a1, at[1], b1))
    return sorted(out)


def densest(pairs: Sequence[tuple[int, int]], n: int, spread: float = SPREAD) -> Sequence[tuple[int, int]]:
    """The longest run of aligned words that lies in at most ``spread`` times the template's ``n`` words of text."""
    best: tuple[int, int] = (0, 0)
    i = 0
    for j in range(len(pairs)):
        while pairs[j][1] - pairs[i][1] + 1 > max(n, spread * n):
            i += 1
        if j + 1 - i > best[1] - best[0]:
            best = (i, j + 1)
    return pairs[best[0] : best[1]]


def _as_table(templates: Mapping[str, str] | Sequence[Template]) -> list[Template]:
    return [Template(*x) for x in (templates.items() if isinstance(templates, Mapping) else templates)]


class Scanner:
    """Templates, ready for many texts."""

    def __init__(self, templates: Mapping[str, str] | Sequence[Template], coverage: float = COVERAGE, spread: float = SPREAD) -> None:
        self.coverage, self.spread = coverage, spread
        self.templates: list[tuple[str, list[str], frozenset[str]]] = []
        for t in _as_table(templates):
            if words := [x[0] for x in words_of(t.text)]:
                keys = t.keys if t.keys is not None else frozenset(words) - GENERIC if len(words) <= NOTICE_WORDS else frozenset()
                self.templates.append((t.licence, words, keys))
        if sum(len(w) for _, w, _ in self.templates) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have over {MAX_TEMPLATE_WORDS} words")
        # Plain words must be in the lower-cased text as they are; others are taken to be there.
        self.plain = [
            (frozenset(x for x in keys if x.isascii()), {} if keys else Counter(x for x in w if x.isascii()), 0 if keys else self.coverage * len(w) - sum(not x.isascii() for x in w))
            for _, w, keys in self.templates
        ]
        self.keys = frozenset(k for keys, _, _ in self.plain for k in keys)
        self.known = frozenset(w for _, words, _ in self.templates for w in words)

    def _near(self, low: str) -> list[int]:
        """The templates that can be in a text."""
        there = {k for k in self.keys if k in low}
        return [i for i, (keys, plain, least) in enumerate(self.plain) if keys <= there and sum(n for w, n in plain.items() if w in low) >= least]

    def _stretches(self, template: Sequence[str], places: Sequence[int]) -> Iterator[tuple[int, int]]:
        """Stretches of the text (first place, end) that can hold the template, by the sorted ``places`` of its words.

        A stretch starts with a word of the template.  Those of short templates start at each; for
        long ones the starts are thinned and the stretches longer by as much.
        """
        n = len(template)
        step = 1 if n <= SHORT else n // 4
        room, least = self._room(n) + step - 1, max(1, ceil(self.coverage * n - 1e-9))
        last = -step
        for k in range(len(places) - least + 1):
            p = places[k]
            if p - last >= step:
                last = p
                if places[k + least - 1] - p < room:
                    yield p, p + room

    def _room(self, n: int) -> int:
        return int(max(n, self.spread * n))

    def _found(self, words: Sequence[str], near: Sequence[int]) -> Iterator[tuple[tuple[int, ...], str, float, int, int, int]]:
        """Order of preference, licence, coverage, matched words, first and last word of every stretch that reaches the limit."""
        hits: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.known:
                hits.setdefault(w, []).append(i)
        for at in near:
            name, template, keys = self.templates[at]
            if any(k not in hits for k in keys):
                continue
            n, need = len(template), Counter(template)
            least = self.coverage * n
            if sum(min(k, len(hits.get(w, ()))) for w, k in need.items()) < least:
                continue
            places = sorted(i for w in need for i in hits.get(w, ()))
            tries = list(self._stretches(template, places))
            if n > SHORT:
                # A copy whose head is whole is also aligned from its head.
                tries += [(p, p + self._room(n)) for p in places if list(words[p : p + 2]) == template[:2]]
            for a, b in tries:
                part = words[a:b]
                if sum((Counter(w for w in part if w in need) & need).values()) < least:
                    continue
                ways = [align(template, part)] if n > SHORT else [align(template, part), _subsequence(template, part)]
                pairs = max((densest(x, n, self.spread) for x in ways), key=lambda x: (len(x), x[0][1] - x[-1][1] if x else 0))
                if pairs and len(pairs) >= least and keys <= {template[i] for i, _ in pairs}:
                    first, last = a + pairs[0][1], a + pairs[-1][1]
                    yield (-len(pairs), n, last - first, first, at), name, len(pairs) / n, len(pairs), first, last

    def spans(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """Licence, coverage, matched words, and the first and last place of every notice or licence text, in the order of the text."""
        if not text:
            return []
        near = self._near(text.lower())
        if not near:
            return []
        found = words_of(text)
        out: list[tuple[str, float, int, int, int]] = []
        firsts: list[int] = []
        lasts: list[int] = []
        for _, name, coverage, matched, first, last in sorted(self._found([x[0] for x in found], near)):
            k = bisect_right(firsts, first)
            if (k and lasts[k - 1] >= first) or (k < len(firsts) and firsts[k] <= last):
                continue
            firsts.insert(k, first)
            lasts.insert(k, last)
            out.insert(k, (name, coverage, matched, found[first][1], found[last][2]))
        return out

    def best(self, spans: Sequence[tuple[str, float, int, int, int]]) -> tuple[str | None, float, int, int, int]:
        """The span with the highest coverage, then the longest template, then the first."""
        return max(spans, key=lambda x: (x[1], x[2])) if spans else (None, 0.0, 0, -1, -1)

    def __call__(self, text: str | None) -> tuple[str | None, float, int, int, int]:
        """Licence, its coverage, matched words, and the first and last place in the text; no licence below the limit."""
        return self.best(self.spans(text))


def scan(docs: DataFrame, templates: Mapping[str, str] | Sequence[Template] | None = None, coverage: float = COVERAGE, spread: float = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, coverage, n_matched, start, stop (code points, -1 without a licence) of every document, and all its ``licences``.

    Without ``templates`` those of ``licence_table`` are looked for.  The columns name the best of the licences; the array has each of them, in the order of the text.
    """
    ship(docs.sparkSession)
    fixed = [tuple(t) for t in _as_table(licence_table() if templates is None else templates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(fixed, coverage, spread)
        names = ("licence", "coverage", "n_matched", "start", "stop")
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                every = [scanner.spans(x) for x in part.column(1).to_pylist()]
                rows = [scanner.best(x) for x in every]
                spans = pa.array([[dict(zip(names, x, strict=True)) for x in s] for s in every], pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), spans], names=["doc_id", *names, "licences"])

    one = "licence string, coverage double, n_matched long, start long, stop long"
    every = one.replace(" ", ": ").replace(",: ", ", ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {one}, licences array<struct<{every}>>")
