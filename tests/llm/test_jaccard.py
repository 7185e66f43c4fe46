from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import jaccard
from loomstead.llm.components import components, extended

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(n_shingles, component_id) by row."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), d if not s else low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)


def test_against_all_pairs(docs, texts):
    assert got(docs.withColumn("unit", F.lit("clash")).withColumn("n", F.lit(1))) == brute([(r[0], r[1]) for r in texts])


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_near_copies(spark, seed):
    """Links that hang together by chains, near the threshold, of small and middling sets."""
    rng = random.Random(seed)
    rows = []
    for family in range(8):
        n = rng.choice([4, 5, 6, 9, 14, 30, 80])
        text = [f"f{family}v{i}" for i in range(n)]
        for _ in range(14):
            rows.append((len(rows) * 7 % 113 + 1000 * family, " ".join(text)))
            text = list(text)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(40)}"
            if rng.random() < 0.3:
                text.append(f"z{rng.randrange(40)}")
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def edited(rng, words, rate):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in words)


def test_any_id(spark):
    """Ids at the ends of their range, negative ones, none, and one id with several texts; rows are compared each by its own text."""
    rng = random.Random(8)
    a, b, c, d = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    near = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    rows = [(2**62, " ".join(a)), (2**63 - 1, near(a, 3)), (2**62 + 5, near(a, 59)), (-5, " ".join(b)), (-(2**63), near(b, 8)), (0, near(b, 1))]
    rows += [(None, " ".join(c)), (None, " ".join(c)), (None, near(c, 5)), (None, edited(rng, c, 0.5)), (None, "alone and without an id here")]
    rows += [(1, " ".join(a[:30] + b[30:])), (1, " ".join(d)), (2, near(d, 7)), (5, near(d, 50)), (7, None), (7, " ".join(d))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(df) == want
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_first(df).collect()), key=str)
    assert len(kept) == 8  # a, b, c, the edited c, the one alone, a with b, d, the one without text
    assert [t for i, t in kept if i is None] and sum(t == " ".join(c) or t == near(c, 5) for _, t in kept) == 1
    assert {i for i, _ in kept} == {2**62, -(2**63), None, 1, 7}


def test_repeated_rows_stay_once(spark):
    rows = [(3, "one two three four five six")] * 3 + [(None, "seven eight nine ten eleven twelve")] * 3 + [(4, " ")] * 2
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", rows[0][1]), ("None", rows[3][1]), ("4", " "), ("4", " ")])


def test_a_large_group_of_near_copies_is_not_expanded(spark, monkeypatch):
    """Near copies of one text that fall into hundreds of components: the pairs that reach a set stay in proportion to the rows."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(110)]
    rows = [(i, edited(rng, base, rng.random() * 0.06)) for i in range(1200)]
    seen = []
    verify = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *rest: seen.append(pairs.count()) or verify(pairs, *rest))
    out = sorted((r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == components_by_matrix(rows)
    assert len({c for _, c in out}) > 100
    assert sum(seen) < 2 * len(rows)


def components_by_matrix(rows):
    """Components of all links, by the product of the matrix of shared shingles with itself."""
    sets = [shingles(t) for _, t in rows]
    count = collections.Counter(s for x in sets for s in x)
    place = {s: i for i, s in enumerate(s for s, k in count.items() if k > 1)}
    m = np.zeros((len(rows), len(place)), dtype=np.float32)
    for i, x in enumerate(sets):
        m[i, [place[s] for s in x if s in place]] = 1
    n, both = np.array([len(x) for x in sets]), (m @ m.T).astype(int)
    links = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(links, True)
    label = np.arange(len(rows))
    while True:
        low = np.where(links, label[None, :], len(rows)).min(1)
        if (low == label).all():
            return sorted((rows[i][0], rows[low[i]][0]) for i in range(len(rows)))
        label = low


def test_other_threshold_and_size(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "q r s t")]
    out = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=72, size=2).collect()}
    assert out == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError, match="too short"):
        jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=60)


def test_empty_table(no_docs):
    assert jaccard.join(no_docs).collect() == []
    assert jaccard.keep_first(no_docs).collect() == []


def test_one_of_each_group_stays(docs, texts):
    kept = [tuple(r) for r in jaccard.keep_first(docs).collect()]
    want = brute([(r[0], r[1]) for r in texts])
    first = {d for d, n, c in want if n == 0 or c == d or d is None}
    assert sorted((r[0] for r in kept), key=str) == sorted(first, key=str)
    assert set(kept) <= set(texts)
    assert jaccard.keep_first(docs).columns == docs.columns


def test_prefix_length():
    assert [jaccard.prefix_length(n, 75) for n in (0, 1, 2, 3, 4, 5, 8, 100)] == [0, 1, 1, 1, 2, 2, 3, 26]


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1060)] + [(5000, 5000), (7, 3)]
    rng.shuffle(links)
    out = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1060)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_are_extended_by_further_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)]
    more = [(rng.randrange(100), rng.randrange(100)) for _ in range(25)]
    kind = "a long, b long"
    first = components(spark.createDataFrame(links, kind))
    got = {r.node: r.label for r in extended(first, spark.createDataFrame([x for x in more if x[0] != x[1]], kind)).collect()}
    assert got == {r.node: r.label for r in components(spark.createDataFrame(links + more, kind)).collect()}
