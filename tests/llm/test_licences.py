from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomstead.llm import licences
from loomstead.llm.licence_table import licence_table
from loomstead.llm.licences import Scanner, align, densest, increasing, scan


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randrange(8) for _ in range(rng.randrange(9))]
        got = increasing(x)
        assert all(a < b for a, b in itertools.pairwise(got)) and all(x[a] < x[b] for a, b in itertools.pairwise(got))
        best = max((n for n in range(len(x) + 1) if any(all(a < b for a, b in itertools.pairwise(c)) for c in itertools.combinations(x, n))), default=0)
        assert len(got) == best


def test_alignment_is_increasing_equal_and_finds_edits():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 25))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 60))]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    words = [f"w{i}" for i in range(50)]
    edited = [*words[:10], "x", *words[10:20], *words[22:]]
    assert len(align(words, ["pre"] * 9 + edited + ["post"] * 5)) == 48


def test_densest_is_the_longest_short_stretch():
    assert list(densest([(0, 0), (1, 100), (2, 101), (3, 103)], 4, 2.0)) == [(1, 100), (2, 101), (3, 103)]
    assert list(densest([], 4)) == []


@pytest.mark.parametrize(("text", "want"), [
    (None, None), ("", None), (" \n", None), ("no licence here", None),
    ("x y\nLicensed under the Apache License, Version 2.0.\nz", "Apache-2.0"),
    ("LICENSED under the\napache licence, version 2.0", "Apache-2.0"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under CC BY-NC 4.0. " * 3, "CC-BY-NC-4.0"),
    ("This work is licensed under the (new) GNU General Public License, version 3.", "GPL-3.0"),
    ("All the " + "other words " * 50 + "rights " + "and more " * 50 + "reserved.", None),
    ("word " * 20000 + "All rights reserved.", "all-rights-reserved"),
])
def test_notices(text, want):
    got = Scanner(licences.TEMPLATES)(text)
    assert got[0] == want
    if want:
        assert got[1] >= 0.8 and text[got[3] : got[4]].lower().split()[0] in ("licensed", "released", "this", "all")


def test_table_against_a_search_for_the_notices(spark):
    rng = random.Random(7)
    names = list(licences.TEMPLATES)
    rows, want = [], {}
    for i in range(60):
        lines = [" ".join(f"q{rng.randrange(99)}" for _ in range(8)) for _ in range(rng.randrange(1, 30))]
        want[i] = rng.choice([*names, None])
        if want[i]:
            lines.insert(rng.randrange(len(lines) + 1), licences.TEMPLATES[want[i]])
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame([*rows, (None, None), rows[0]], "doc_id long, text string").withColumn("coverage", F.lit("x")).withColumn("licence", F.lit(1))
    out = scan(df).collect()
    assert len(out) == 62
    assert all(r.licence == want.get(r.doc_id) for r in out)
    assert all((r.coverage, r.n_matched, r.start) == (0.0, 0, -1) for r in out if r.licence is None)
    assert scan(df.limit(0)).collect() == []


def test_templates_without_words_and_size_bound():
    assert Scanner({"none": "...", "MIT": "Released under the MIT License."})("Released under the MIT License.")[0] == "MIT"
    with pytest.raises(ValueError, match="templates"):
        Scanner({"big": "w " * (licences.MAX_TEMPLATE_WORDS + 1)})


def test_a_long_template_with_repeated_words():
    rng = random.Random(9)
    words = [f"t{rng.randrange(300)}" for _ in range(3000)]
    text = ["x"] * 500 + [w for w in words if rng.random() > 0.05] + ["y"] * 500
    name, coverage, *_ = Scanner({"long": " ".join(words)})(" ".join(text))
    assert name == "long" and 0.93 < coverage < 0.97


def test_common_words_and_repeats_do_not_hide_a_notice():
    notice = licences.TEMPLATES["GPL-3.0"]
    text = f"this old work there is {'of the under words and on it goes ' * 8} {notice}\n{notice} end"
    assert Scanner(licences.TEMPLATES)(text)[:2] == ("GPL-3.0", 1.0)
    spans = Scanner(licences.TEMPLATES).spans(text)
    assert [(x[0], x[1], text[x[3] : x[4]]) for x in spans] == [("GPL-3.0", 1.0, notice.rstrip("."))] * 2


def test_every_licence_of_a_document_is_reported(spark):
    names = ["MIT", "GPL-3.0", "MIT", "CC-BY-NC-4.0"]
    text = "\n".join(f"{licences.TEMPLATES[x]} some words between" for x in names)
    out = scan(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")).collect()
    assert [[x.licence for x in r.licences] for r in out] == [names, [], []]
    assert all(text[x.start : x.stop] == licences.TEMPLATES[x.licence].rstrip(".") for x in out[0].licences)


def test_a_long_template_twice():
    rng = random.Random(4)
    words = [f"t{rng.randrange(90)}" for _ in range(300)]
    copy = " ".join(words)
    spans = Scanner({"long": copy})(None), Scanner({"long": copy}).spans(f"t1 t2 x y {copy} t3 t4 {copy}")
    assert spans[0][0] is None and [x[1] for x in spans[1]] == [1.0, 1.0]


@pytest.fixture(scope="module")
def table():
    return Scanner(licence_table())


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the BSD License.", "BSD"),
    ("Released under the WTFPL License.", None),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-NC-ND 3.0.", "CC-BY-NC-ND-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
])
def test_names_and_versions_are_told_apart(table, text, want):
    assert table(text)[0] == want


def test_every_template_is_its_own_licence(table):
    for t in licence_table():
        own = f"some words before it\n\n{t.text}\n\nand some after it"
        assert table(own)[0] == t.licence, t.text[:80]
        assert [x[0] for x in table.spans(own)] == [t.licence], t.text[:80]


def test_whole_texts_with_edits_are_found_in_a_table(spark):
    rng = random.Random(3)
    texts = {t.licence: t.text for t in licence_table()[:20]}
    rows = [(i, f"head of a file\n{' '.join(w for w in x.split() if rng.random() > 0.01)}\nfoot") for i, x in enumerate((texts["MIT"], texts["GPL-2.0"]))]
    assert sorted((r.doc_id, r.licence) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(0, "MIT"), (1, "GPL-2.0")]


def longest_common(a, b):
    """Length of a longest common subsequence, by dynamic programming."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        last = row
    return last[-1]


@pytest.mark.parametrize("licence", ["MIT", "ISC", "BSD-3-Clause", "Zlib"])
def test_coverage_against_dynamic_programming(licence):
    """On changed texts the aligned words are nearly as many as an optimal alignment has, and the reported coverage is theirs."""
    rng = random.Random(licence)
    template = next(t for t in licence_table() if t.licence == licence and len(t.text.split()) > 60)
    a = [w for w, _, _ in licences.words_of(template.text)]
    scanner = licences.Scanner([template])
    keys = scanner.templates[0][2]
    for rate in (0.0, 0.02, 0.05, 0.1):
        words = []
        for w in a:
            if rng.random() < rate:
                words += rng.choice([[], ["other"], [w, "inserted", "words"]]) if w not in keys else [w]
            else:
                words.append(w)
        best = longest_common(a, words)
        assert best >= len(licences.align(a, words)) >= 0.97 * best
        before, after = ([f"x{rng.randrange(50)}" for _ in range(200)] for _ in range(2))
        found = scanner(" ".join([*before, *words, *after]))
        assert found[0] == licence and best >= found[2] >= 0.97 * best and found[1] == found[2] / len(a)
