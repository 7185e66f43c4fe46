from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import quality_model as qm


def corpus(n=400):
    """Good prose, and junk of symbols, shouting and repetition."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(30, 120))]
        good = i % 3 > 0
        if not good:
            w = [[x + "###" for x in w], [x.upper() + "!!" for x in w], w[:5] * 12][i // 3 % 3]
        rows.append((i, " ".join(w), int(good)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    out = qm.classify(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_held_out_labels_language_source_and_id_do_not_matter(labelled):
    docs, labels, _ = labelled
    a = {r.doc_id: r.score for r in qm.classify(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(qm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = {r.doc_id: r.score for r in qm.classify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), flipped).collect()}
    assert a == b
    assert a == {r.doc_id: r.score for r in qm.classify(docs.repartition(5), labels.repartition(3)).collect()}


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(1)
    x = np.zeros((3, qm.WIDTH), dtype=np.float32)
    for row in x:
        row[rng.integers(0, qm.WIDTH, 12)] = rng.random(12)
    m = qm.Machine(rng.normal(size=qm.WIDTH).astype(np.float32), rng.normal(size=(qm.WIDTH, qm.RANK)).astype(np.float32) / 3)
    want = []
    for row in x.astype(np.float64):
        on = np.flatnonzero(row)
        z = row @ m.w + sum(float(m.v[i].astype(np.float64) @ m.v[j]) * row[i] * row[j] for a, i in enumerate(on) for j in on[:a])
        want.append(1 / (1 + np.exp(-z)))
    assert m.score(x) == pytest.approx(want, abs=1e-4)


def test_edge_cases(labelled, docs, texts, no_docs, spark):
    train, labels, _ = labelled
    machine = qm.train(train, labels)
    out = qm.score(docs.withColumn("score", F.lit("x")).withColumn("doc", F.lit(1)), machine).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out for r in out if r.doc_id is None)
    by_text = {}
    for r, t in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(texts, key=lambda t: str(t[0])), strict=True):
        assert by_text.setdefault(t[1], r.score) == pytest.approx(r.score, abs=1e-6)
    assert qm.classify(no_docs, labels).collect() == []
    none = labels.limit(0)
    assert {r.score for r in qm.classify(train.limit(3), none).collect()} == {0.5}
    ones = labels.where("quality = 1")
    assert {r.predicted for r in qm.classify(train, ones).collect()} == {1}
    odd = spark.createDataFrame([(1, None, 0), (2, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in qm.classify(train.limit(3), odd).collect()} == {0.5}
    assert {r.score for r in qm.classify(train.drop("n_chars").limit(3), none).collect()} == {0.5}


def test_keep_good_keeps_columns(labelled):
    docs, labels, truth = labelled
    kept = qm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids ^ {i for i, y in truth.items() if y}) < 10


def test_sparse_scores_are_the_dense_ones(texts):
    rng = np.random.default_rng(2)
    machine = qm.Machine(rng.normal(size=qm.WIDTH).astype(np.float32), (0.1 * rng.standard_normal((qm.WIDTH, qm.RANK))).astype(np.float32))
    rows = [qm.features(None if r[1] is None else np.frombuffer(r[1].encode(), dtype=np.uint8), r[4]) for r in texts]
    x = np.zeros((len(rows), qm.WIDTH), dtype=np.float32)
    for i, (places, values) in enumerate(rows):
        x[i, places] = values
    assert machine.score_sparse(rows) == pytest.approx(machine.score(x), abs=1e-4)
    assert machine.score_sparse([]).tolist() == []


def test_training_holds_no_dense_sample(labelled, monkeypatch):
    docs, labels, truth = labelled
    whole = qm.train(docs, labels)
    monkeypatch.setattr(qm, "BLOCK", 30, raising=False)
    learnt = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in truth)
    tracemalloc.start()
    try:
        machine = qm.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * learnt * qm.WIDTH
    assert machine.w == pytest.approx(whole.w, abs=1e-3) and machine.v == pytest.approx(whole.v, abs=1e-3)
