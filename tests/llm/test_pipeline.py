"""The stages, each on its own input against the brute force of its operator; columns, order, and the run of them all."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import test_jaccard
import test_line_quality
import test_mixing
from pyspark.sql import functions as F

import corpus_pipeline
from loomstead.llm import quality_model
from loomstead.llm.queries import token_file


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "CAST(text IS NOT NULL AND NOT text LIKE '%###%' AS INT) AS quality", "0 AS toxic").distinct()
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_as_asked():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "rules", "near_duplicates", "mixture", "packed"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_the_columns_and_act(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.toArrow(), out.schema)
        sizes.append(docs.count())
        assert docs.where("n_chars <> length(text)").count() == 0
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0
    assert docs.where("text LIKE '%###%'").count() == 0


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stored = lambda df: spark.createDataFrame(df.toArrow(), df.schema)
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text", "source").collect()), key=str)

    machine = quality_model.train(docs, labels)

    def good(r):
        places, values = quality_model.features(None if r.text is None else np.frombuffer(r.text.encode(), dtype=np.uint8), r.n_chars)
        z = float(machine.w[places] @ values) + sum(float(machine.v[a] @ machine.v[b]) * x * y for i, (a, x) in enumerate(zip(places, values, strict=True)) for b, y in zip(places[:i], values[:i], strict=True))
        return 1 / (1 + np.exp(-z)) >= 0.3

    short = [r for r in docs.collect() if len(r.text or "") < 1500]  # every pair of features is summed
    kept = stored(corpus_pipeline.quality(spark, docs, folder))
    left = Counter(tuple(r) for r in kept.collect())
    assert all((left[tuple(r)] > 0) == good(r) for r in short)

    before = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    lost = test_line_quality.brute([(t, s) for _, t, s in before], 20, 0.5)
    want = []
    for (d, t, s), gone in zip(before, lost, strict=True):
        n, *_, repeated = test_line_quality.base(t)
        if n >= 10 and 100 * repeated <= 20 * n and n - gone >= 0.2 * n:
            want.append((d, n - gone, s))
    kept = stored(corpus_pipeline.rules(spark, kept, folder))
    assert sorted(((d, len((t or "").split()), s) for d, t, s in rows(kept)), key=str) == sorted(want, key=str)

    before = [(d, t) for d, t, _ in rows(kept)]
    groups = {c for d, n, c in test_jaccard.brute(before) if n and c is not None}
    alone = Counter(d for d, n, c in test_jaccard.brute(before) if c is None)
    kept = stored(corpus_pipeline.near_duplicates(spark, kept, folder))
    assert sorted(d for d, _, _ in rows(kept) if d is not None) == sorted(groups)
    assert sum(d is None for d, _, _ in rows(kept)) <= alone[None]

    taken = {d: k for d, _, _, _, k in test_mixing.brute(rows(kept)) if k}
    kept = stored(corpus_pipeline.mixture(spark, kept, folder))
    words = Counter()
    for d, t, _ in rows(kept):
        words[d] += len(t.split())
    assert words == taken

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_file())
    tokens = Counter()
    for d, t, _ in rows(kept):
        tokens[d] += len(library.encode(t, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.packed(spark, kept, folder).collect():
        got[r.doc_id] += r.length
    assert got == tokens


def test_run_packs_what_the_mixture_takes(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == at
        at += r.length


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count(F.lit(1))).first()[0] == 0


@pytest.fixture
def many_files(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def packed_order(rows):
    return [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]


def test_packing_keeps_the_order_of_files_of_unequal_size(spark, many_files, tmp_path):
    docs = spark.range(0, 400, 1, 5).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, id), x -> hash(id, x))) AS text")
    docs.write.option("parquet.block.size", "50000").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert [r.doc_id for r in stored.select("doc_id").collect()] != list(range(400))
    assert packed_order(corpus_pipeline.packed(spark, stored, "").collect()) == list(range(400))


def test_run_packs_in_the_order_of_the_curriculum(spark, folder, many_files, monkeypatch):
    stages = {}

    def recorded(df, name, keep=corpus_pipeline.written):
        stages[name] = keep(df, name)
        return stages[name]

    monkeypatch.setattr(corpus_pipeline, "written", recorded)
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    got = packed_order(corpus_pipeline.run(spark, folder).collect())
    stored = stages["mixture"].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert len({r.file_name for r in stored}) > 1
    assert got == [r.doc_id for r in sorted(stored, key=lambda r: (r.file_name, r.row_index))]
