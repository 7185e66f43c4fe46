"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all the rows it is given and returns a DataFrame.  All but the last
return the columns of ``documents``.  ``run`` writes each stage's result to the
folder that all executors share and reads it again for the next one.

1. The factorisation machine rejects documents of low quality.
2. Base rules and cross-document line frequency reject documents and remove
   common lines from the others.
3. Of each group of near-duplicates (Jaccard similarity of five-word shingles
   at least 0.75, links closed) the document with the smallest id stays.
4. Sources are mixed to their target weights: documents are repeated or left
   out; the copy in which a source's target ends is cut at that word.
   Rows are in the order of the curriculum.
5. Documents are packed into windows of 2048 tokens, in the order of the files
   and rows of stage 4, which is that of the curriculum.

Defined results, stage by stage, are those of the operators: a null or empty text
is scored on its structure (1) and fails the base rules (2), so that none
comes to stage 3; very long texts are read whole; rows without an id are rows like
any other, and of exact copies one stays, with or without an id; repeated rows are
one document after stage 3; a null source is a source and a host of its own; an
empty table gives no rows.  Columns beside id, text, source and length are
carried, whatever their names, up to stage 4.  ``run`` deletes what a stage has
written for itself once its result is stored, and a stage's result once the next
one is; what the last stage reads stays (``forget_since`` deletes it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import jaccard, line_quality, mixing, packing, quality_model
from loomstead.llm._shared import forget, forget_since, n_live, written
from loomstead.llm.queries import token_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, predicts to be good; null and empty texts are scored on their structure, repeated rows alike."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough of their words, without their common lines; texts without ten words go."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; texts without a word are in no group and stay."""
    return jaccard.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in the order of the curriculum, up to their sources' targets; texts without a word have none."""
    return mixing.training_stream(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences; a null or empty text has the end token alone."""
    return packing.pack(docs, token_file(), by_file=_read_from_files(docs))


def _read_from_files(docs: DataFrame) -> bool:
    """Whether the rows have a place in a file; those of tables that were never written keep the order they come in."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = n_live()
        result = written(stage(spark, docs, sf_dir), name)
        forget_since(spark, mark, keep=result)
        forget(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
