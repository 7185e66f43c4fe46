from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomstead.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated sharing of what is above the caps."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]} if total else set()
        if not over:
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
        open_ -= over
    return target | {s: left * w[s] / total for s in open_}


def brute(rows):
    sized = [(d, s, len(WORD.findall(t or ""))) for d, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    target, out = goals(sizes), []
    key = lambda d: (int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:15], 16), d if d is not None else -1)
    for source in sizes:
        goal, at = int(target[source] + 0.5), 0
        for d, _, n in sorted((x for x in sized if x[1] == source), key=lambda x: (*key(x[0]), x[2])):
            taken = sum(max(0, min(n, goal - k * sizes[source] - at)) for k in range(3))
            out.append((d, n, sizes[source], round(target[source], 6), taken))
            at += n
    return sorted(out, key=str)


def test_against_brute_force(docs, texts):
    out = mixing.mix(docs.withColumn("size", F.lit("x")).withColumn("bucket", F.lit(1))).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(((*r[:3], round(r[3], 6), r[4]) for r in out), key=str) == brute([(r[0], r[1], r[3]) for r in texts])


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1, "d": 1}, {"a": 1, "b": 2, "c": 300, None: 5}, {"a": 0, "b": 10}, {"a": 7}, {"a": 0}, {"a": 3, "b": 3, "c": 3, "d": 3, "e": 3, "f": 3, "g": 1000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    out = {r.source: r.target for r in mixing.targets(df, (1, 2, 3), 3).collect()}
    want = goals(sizes)
    assert out == pytest.approx(want)
    assert sum(out.values()) == pytest.approx(sum(sizes.values()))


def test_counting_words(spark):
    cases = ["", " ", "a", " a", "a ", " a \n b\t", "\x0b\x0c", "a\u00a0b", "字 é", None, "a\x0bb\x0cc\rd"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, t string")
    assert [r[1] for r in df.select("i", mixing.count_words(F.col("t"))).orderBy("i").collect()] == [len(WORD.findall(x or "")) for x in cases]


def test_positions_follow_the_schedules(docs):
    rows = mixing.mix(docs).collect()
    for r in rows:
        places = [c.position for c in r.copies]
        assert places == sorted(places) and all(-1e-9 <= p < 1 for p in places)
        assert sum(c.words for c in r.copies) == r.taken <= 3 * r["size"]
        assert r.position == (places[0] if places else None)
    mean = lambda s: sum(c.position * c.words for r in rows if r.source == s for c in r.copies) / sum(r.taken for r in rows if r.source == s)
    assert mean("s0") < mean("s2")  # weight 1 comes early, weight 3 late
    order = [r.position for r in rows if r.position is not None]
    assert order == sorted(order)


def test_reruns_and_partitions_agree(docs):
    a = sorted(map(str, mixing.mix(docs).collect()))
    assert a == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_stream_of_copies(docs):
    rows = mixing.training_stream(docs)
    assert rows.columns == docs.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    want = defaultdict(int)
    for r in mixing.mix(docs).where("taken > 0").collect():
        want[r.doc_id, r.source] += r.taken
    assert got == want


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.training_stream(no_docs).collect() == []
