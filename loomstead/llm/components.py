"""Connected components of a table of links, by alternating large and small stars.

Each round joins every node's links with the smallest node next to it and
writes the links that result, so that a lost executor costs a re-read.  Links
never leave the executors; the driver sees a count and a checksum a round.
Minima are combined before the shuffle and a node with very many links is a
skewed join key, which Spark's adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._shared import forget, written

MAX_ROUNDS = 60


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple[int, int | None]]:
    """Links, written, with their number and a checksum, which come with the write."""
    seen = Observation()
    stored = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")), "links")
    return stored, (seen.get["n"], seen.get["s"])


def extended(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) of the links behind ``labels`` and ``more`` (a, b) together: only labels that new links join are followed anew."""

    def at(x: str) -> DataFrame:
        return labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))

    named = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    named = written(named, "links")
    joined = written(components(named.select(F.col("la").alias("a"), F.col("lb").alias("b"))), "labels")
    nodes = labels.unionByName(named.selectExpr("stack(2, a, la, b, lb) AS (node, label)")).distinct()
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return nodes.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): each node of ``links`` (a, b) with the smallest node that it is connected to."""
    edges, before = _stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        step = written(large, "links")
        low = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after, state = _stored(small)
        forget(step)
        forget(edges)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
