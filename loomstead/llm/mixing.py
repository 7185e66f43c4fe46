"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only.  Every source has a target of words (water-filling
under a cap on its repeats) and a weight schedule that runs linearly from its
first to its last value over training time 0 to 1.  The integral of the
schedule, scaled to the target, is the source's cumulative demand for words;
the inverse of that integral gives the time at which the source's n-th word is
wanted, hence the training position of each copy of each document.  Documents
are range-sorted by the position of their first copy.

Within a source the documents stand in the order of a hash of their id and
are repeated end to end until the target is met; the word at which the target
ends cuts the last copy.  A prefix sum over hash buckets finds each document's
place, so that a source with a third of all rows is spread over all buckets.

Defined results: a null or empty text has size 0 and no copies; null sources
form one source, ordered last; a null doc_id is hashed as an empty string;
repeated rows are documents of their own; an empty table gives no rows.
Columns of the input other than the id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: First and last value of the weight schedule, for weights 1, 2, 3: light sources come early and heavy ones late.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def count_words(text: Column) -> Column:
    """Number of runs of characters other than U+0020 and U+0009 to U+000D; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, r"[\x20\x09-\x0D]+"))
    blank = r"[\x20\x09-\x0D]"
    return F.when(t == "", F.lit(0)).otherwise(parts - F.rlike(t, F.lit("^" + blank)).cast("int") - F.rlike(F.right(t, F.lit(1)), F.lit("^" + blank)).cast("int")).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Adds rank, weight and target to a table of (source, source_size).

    All words are shared by weight; a source whose share is above ``cap`` times
    its size gets that much, and the rest is shared among the others again.  In
    the order of cap over weight the capped sources come first, so that one
    running sum finds the level at which none is above.
    """
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1))
    most = (F.col("source_size") * cap).cast("long")
    by_level = Window.partitionBy(F.lit(0)).orderBy(most / F.col("weight"), "rank")
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(most).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    open_ = ranked.withColumn("left", left).withColumn("heavy", heavy)
    # The level is met at the first source whose cap is not reached; before it, left over heavy exceeds the cap.
    met = F.when(most * F.col("heavy") > F.col("left") * F.col("weight"), F.struct(F.row_number().over(by_level).alias("at"), F.col("left").alias("left"), F.col("heavy").alias("heavy")))
    level = open_.withColumn("met", met).withColumn("level", F.min("met").over(whole))
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.heavy")
    return level.select("source", "source_size", "rank", "weight", F.coalesce(F.least(most.cast("double"), share), most.cast("double")).alias("target"))


def _inverse(q: Column, first: Column, last: Column) -> Column:
    """Time at which the share ``q`` of a linear schedule's integral is reached."""
    a, c = (last - first) / 2, q * (first + last) / 2
    root = (F.sqrt(first * first + 4 * a * c) - first) / (2 * a)
    return F.when(a == 0, q).otherwise(root)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    ramps: Sequence[tuple[float, float]] = RAMPS,
    bucket_digits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row for each document, range-sorted by position.

    Columns: doc_id, source, size, source_size, target, taken (words, repeats
    counted), position (of the first copy, null if nothing is taken), copies
    (array of copy, words, position).  Documents fall into 16 to the power
    ``bucket_digits`` buckets of each source.  ``row_col``, a number for each row,
    is carried along as ``row`` and settles ties.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"),
        F.conv(F.substring(digest, 1, bucket_digits), 16, 10).cast("int").alias("bucket"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"),
        *([F.col(row_col).cast("long").alias("row")] if row_col else []),
    )
    sized = written(sized, "sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    starts = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    placed = buckets.withColumn("bucket_start", starts).join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own", "words")
    right = placed.select(F.col("source").alias("own"), F.col("bucket").alias("own_bucket"), "bucket_start", "source_size", "target", "weight")
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *(["row"] if row_col else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("bucket_start") + F.col("before")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    own = sized.withColumn("before", F.sum("size").over(inner) - F.col("size")).join(right, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("own_bucket")))
    ramp = F.array(*[F.struct(F.lit(float(a)).alias("first"), F.lit(float(b)).alias("last")) for a, b in ramps])
    own = own.withColumn("start", start).withColumn("goal", goal).withColumn("ramp", F.element_at(ramp, F.pmod(F.col("weight") - 1, F.lit(len(ramps))) + 1))

    def copy(i: Column) -> Column:
        demand = i * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - demand)).cast("long")
        return F.struct(i.alias("copy"), words.alias("words"), _inverse(demand / F.greatest(F.col("goal"), F.lit(1)), F.col("ramp.first"), F.col("ramp.last")).alias("position"))

    copies = F.filter(F.transform(F.array(*[F.lit(i) for i in range(cap)]), copy), lambda x: x["words"] > 0)
    out = own.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.get("copies", F.lit(0))["position"].alias("position"),
        "copies",
        *(["row"] if row_col else []),
    )
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    ends = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(ends, 1, n.cast("int")), "")


def training_stream(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, ramps: Sequence[tuple[float, float]] = RAMPS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The documents as they are trained on: a row for each copy, in their own columns, range-sorted by position.

    A copy of fewer words than its document has the text cut after them and
    ``chars_col`` set to its length.
    """
    numbered = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    parts = numbered.select("row", F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"), F.col(f"doc.`{source_col}`").alias("source"))
    copies = mix(parts, weights, cap, ramps, row_col="row").where("taken > 0").select("row", "size", F.explode("copies").alias("c"))
    rows = numbered.join(copies, "row").repartitionByRange("c.position").sortWithinPartitions("c.position")
    whole, cut = F.col("c.words") == F.col("size"), first_words(F.col(f"doc.`{text_col}`"), F.col("c.words"))
    out = []
    for c in docs.columns:
        own = F.col(f"doc.`{c}`")
        if c == text_col:
            own = F.when(whole, own).otherwise(cut)
        elif c == chars_col:
            own = F.when(whole, own).otherwise(F.length(cut)).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return rows.select(*out)


#: DuckDB SQL of the contract's columns of ``mix`` over ``documents``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
src AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM src),
lev AS (
  SELECT *, SUM(source_size) OVER () - coalesce(SUM(3 * source_size) OVER (ORDER BY 3 * source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         SUM(w) OVER (ORDER BY 3 * source_size / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy,
         row_number() OVER (ORDER BY 3 * source_size / w, rk) AS nth
  FROM ranked),
cut AS (SELECT rest, heavy FROM lev WHERE 3 * source_size * heavy > rest * w ORDER BY nth LIMIT 1),
tgt AS (
  SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), CAST((SELECT rest FROM cut) AS DOUBLE) * w / (SELECT heavy FROM cut)), 3.0 * source_size)::DOUBLE AS target
  FROM ranked),
placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         SUM(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) + greatest(0, least(size, goal - 2 * source_size - start)) AS BIGINT) AS taken
FROM placed
"""
