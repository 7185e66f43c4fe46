from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomstead.llm import line_quality
from loomstead.llm._text import ORDER_POWERS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g, n in Counter(windows).items() if n > 1}
    covered = {i + o for i, g in enumerate(windows) if g in twice for o in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return " ".join(re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x)) for x in WORD.findall(line))


def brute(rows, limit, share):
    """{row number: removed words} by the rules of the module."""
    per, bodies = [], []
    for text, host in rows:
        lines = [normal(x) for x in (text or "").split("\n") if WORD.search(x)]
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), x).encode() for x in WORD.findall(text or "")] or [b""]
        windows = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
        order = [sum((c + 1) * p for c, p in zip(x[0], ORDER_POWERS, strict=False)) % 2**64 for x in windows]
        sign = [tuple(windows[order.index(end)]) for end in (min(order), max(order))]
        sizes = Counter()
        for x in lines:
            sizes[x] += len(x.split(" "))
        per.append((host, sizes))
        bodies.append((tuple(sorted(sizes.items())), tuple(sign)))
    held = defaultdict(set)
    for (host, sizes), body in zip(per, bodies, strict=True):
        for x in sizes:
            held[host, x].add(body)
    common = {k for k, v in held.items() if len(v) > limit and max(len({signs[i] for _, signs in v}) for i in (0, 1)) >= share * len(v)}
    return [sum(n for x, n in sizes.items() if (host, x) in common) for host, sizes in per]


def test_against_brute_force(docs, texts):
    out = line_quality.judge(docs.withColumn("line", F.lit(1)).withColumn("host", F.lit("x")), max_documents=5).collect()
    lost = brute([(r[1], r[3]) for r in texts], 5, 0.5)
    assert sum(n > 0 for n in lost) > 20
    want = []
    for r, gone in zip(texts, lost, strict=True):
        b = base(r[1])
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        want.append((r[0], *b, failed, not failed and b[0] - gone >= 0.2 * b[0], gone))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_copies_are_no_evidence_but_boilerplate_is(spark):
    page = "alpha beta gamma delta epsilon zeta\neta theta iota kappa lambda mu"
    rows = [(i, page, "h") for i in range(50)]
    name = lambda i: "own" + chr(97 + i // 26) + chr(97 + i % 26)
    rows += [(100 + i, f"{' '.join(f'{name(i)} n{k}' for k in range(8))}\nshared foot of the page\nlast {name(i)} words of page", "h") for i in range(30)]
    out = {r.doc_id: (r.kept, r.n_removed) for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i] == (True, 0) for i in range(50))
    assert all(out[100 + i] == (True, 5) for i in range(30))


def test_blocks_of_lines_go_and_edited_copies_stay(spark):
    """Boilerplate of several lines, at either end and within, is common; the lines of a page's edited copies are not."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(3))
    line = lambda: " ".join(word() for _ in range(12))
    head, body, foot = [line() for _ in range(3)], [line() for _ in range(4)], [line() for _ in range(2)]
    rows = [(i, "\n".join([*head, line(), line(), line(), *body, line(), line(), line(), line(), *foot]), "h") for i in range(40)]
    page = [[word() for _ in range(12)] for _ in range(20)]
    for i in range(100, 160):
        copy = [list(x) for x in page]
        for _ in range(12):  # one word in twenty
            copy[rng.randrange(20)][rng.randrange(12)] = word()
        rows.append((i, "\n".join(" ".join(x) for x in copy), "h"))
    out = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].n_removed == 9 * 12 and out[i].kept for i in range(40))
    assert all(out[i].n_removed == 0 and out[i].kept for i in range(100, 160))


def test_depleted_documents_go(spark):
    foot = "one two three four five six seven eight nine ten eleven twelve"
    stubs = [(i, f"a{chr(97 + i)} b\n{foot}\nc{chr(97 + i)}", "h") for i in range(30)]
    pages = [(100 + i, f"{' '.join(f'{chr(97 + i % 26)}own{chr(97 + i // 26)}{chr(97 + k)}' for k in range(60))}\n{foot}", "h") for i in range(100)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_quality.judge(frame(stubs + pages), min_remaining=0.4).collect()
    assert all(r.n_removed == 12 and not r.base_failed and r.kept == (r.doc_id >= 100) for r in out)
    # Alone, pages of little else than the same line are copies of one another.
    assert all(r.kept and not r.n_removed for r in line_quality.judge(frame(stubs), min_remaining=0.4).collect())


def test_clean_removes_lines_and_keeps_columns(docs):
    out = line_quality.clean(docs, max_documents=5)
    assert out.columns == docs.columns
    kept = out.collect()
    assert not any("foot of every page" in r.text for r in kept)
    assert all(r.n_chars == len(r.text) for r in kept)
    ids = sorted(str(r.doc_id) for r in line_quality.judge(docs, max_documents=5).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept) == ids


def test_empty_table(no_docs):
    assert line_quality.judge(no_docs).collect() == [] and line_quality.clean(no_docs).collect() == []


def test_lines_are_cut_by_the_hashes_of_measure():
    text = "a LINE of 25 words\n\n \t\nanother, line\r\nA line  of 99 words\nlast é"
    kinds, words = line_quality.measure(np.frombuffer(text.encode(), dtype=np.uint8))[5]
    assert sorted(words.tolist()) == [2, 2, 10]
    gone = kinds[words == 10]
    assert line_quality.without_lines(text, gone) == "\n \t\nanother, line\r\nlast é"
    assert line_quality.without_lines(text, kinds) == "\n \t"
    assert line_quality.without_lines(text, gone + np.uint64(1)) == text
