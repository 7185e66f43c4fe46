"""Parquet tables, tables derived from them, and synthetic columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.fixed import cents, idiv
from loomstead.operators.table import Table


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def save(table: Table | DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a table as Parquet."""
    df = table.df if isinstance(table, Table) else table
    df.write.mode(mode).partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode(mode).parquet(path)


class Tables:
    """The tables of one folder as attributes: ``Tables(spark, folder).lineitem``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load(self.spark, self.folder, name)

    @property
    def partsupp(self) -> DataFrame:
        """Which supplier has offered which part, from the order lines: ps_partkey, ps_suppkey, ps_supplycost (cents), ps_availqty."""
        line = self.lineitem
        unit = idiv(cents("l_extendedprice"), F.greatest(F.col("l_quantity").cast("bigint"), F.lit(1)))
        keys = [F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")]
        return line.groupBy(*keys).agg(F.min(unit).alias("ps_supplycost"), F.sum(F.col("l_quantity").cast("bigint")).alias("ps_availqty"))


def primary_key(n: int, name: str, spark: SparkSession) -> DataFrame:
    """A column of 1 to ``n``."""
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def uniform(low: int, high: int, seed: int, row: Column) -> Column:
    """Whole numbers in [low, high), the same for the same row and seed."""
    return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), row), F.lit(high - low))).cast("bigint")


def generate(spark: SparkSession, n: int, key: str, seed: int = 42, **ranges: tuple[int, int]) -> Table:
    """A synthetic table of ``n`` rows: a primary key and uniform columns, made on the executors."""
    df = primary_key(n, key, spark)
    return Table(df.select(key, *[uniform(a, b, seed + i, F.col(key)).alias(c) for i, (c, (a, b)) in enumerate(ranges.items())]), key)
