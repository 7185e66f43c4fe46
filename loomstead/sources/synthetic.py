"""Synthetic tables of two schemas: the order tables and twelve application tables.

A table is a rule for its row count and a rule for each column: the primary key, a
range of whole numbers, or an expression over columns made before.  Rows are
made on the executors from ``spark.range``; the same table, scale and seed give the
same rows on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.fixed import idiv
from loomstead.operators.table import Table

from .tables import uniform

KEY = "key"

# Rows at scale 1, and the half-open ranges of the columns.  A text in
# a range is a table: its row count is the bound.

ROWS = {
    "lineitem": 6_000_000, "orders": 1_500_000, "customer": 150_000, "part": 200_000, "supplier": 10_000, "partsupp": 800_000,
    "secrecy_r": 2_000_000, "secrecy_s": 3_000_000, "secrecy_t1": 2_000_000, "secrecy_t2": 1_000_000, "secrecy_t3": 1_000_000, "cohort": 500_000,
    "diagnosis_comorbidity": 5_000_000, "diagnosis": 3_000_000, "medication": 2_000_000, "password": 5_000_000, "taxi": 5_000_000, "credit_score": 5_000_000,
}
FIXED_ROWS = {"nation": 25, "region": 5}

RANGES: dict[str, dict[str, object]] = {
    "lineitem": {
        "no": KEY, "l_orderkey": (1, "orders"), "l_partkey": (1, "part"), "l_suppkey": (1, "supplier"), "l_quantity": (1, 51), "l_extendedprice": (90, 111), "l_discount": (0, 10), "l_tax": (0, 8),
        "l_returnflag": (0, 3), "l_linestatus": (0, 2), "l_shipdate": (1, 121), "l_commitdate": (30, 90), "l_receiptdate": (1, 30), "l_shipinstruct": (0, 4), "l_shipmode": (0, 7), "l_comment": (0, 100),
    },
    "orders": {"o_orderkey": KEY, "o_custkey": (1, "customer"), "o_orderstatus": (0, 3), "o_totalprice": (90, 111), "o_orderdate": (1, 121), "o_orderpriority": (1, 6), "o_clerk": (1, 1_000_000), "o_shippriority": (0, 1), "o_comment": (1, 1_000_000)},
    "customer": {"c_custkey": KEY, "c_name": None, "c_address": (1, "customer"), "c_nationkey": (1, 25), "c_acctbal": (0, 99_999), "c_phone": (1_000_000, 9_999_999), "c_cntrycode": None, "c_mktsegment": (1, 6), "c_comment": (1, 1_000_000)},
    "part": {"p_partkey": KEY, "p_name": (1, 21), "p_mfgr": (1, 25), "p_brand": (1, 26), "p_type": (1, 11), "p_size": (1, 51), "p_container": (1, 41), "p_retailprice": (1, 9_999_999), "p_comment": (1, 1_000_000)},
    "supplier": {"s_suppkey": KEY, "s_name": None, "s_address": (1, 100_000), "s_phone": (1_000_000_000, 2_000_000_000), "s_nationkey": (1, 25), "s_acctbal": (0, 10_000), "s_comment": (1, 1_000_000)},
    "partsupp": {"ps_partkey": KEY, "ps_suppkey": None, "ps_availqty": (1, 1_000_000), "ps_supplycost": (1, 1_000_000), "ps_comment": (1, 1_000_000)},
    "nation": {"n_nationkey": KEY, "n_name": None, "n_regionkey": (1, 5), "n_comment": (1, 1_000_000)},
    "region": {"r_regionkey": KEY, "r_name": None, "r_comment": (1, 1_000_000)},
    "secrecy_r": {"id": (0, "root secrecy_r"), "ak": (0, "root secrecy_r")},
    "secrecy_s": {"id": (0, "root secrecy_s")},
    "secrecy_t1": {"person": (0, "root secrecy_t1"), "coinsurance": (0, 100), "state": (0, 50)},
    "secrecy_t2": {"person": (0, "root secrecy_t2"), "disease": (0, 100), "cost": (0, 10_000)},
    "secrecy_t3": {"disease": (0, 100), "class_": (0, 16)},
    "cohort": {"pid": KEY},
    "diagnosis_comorbidity": {"pid": (0, "2 cohort"), "diag": (0, 1000)},
    "diagnosis": {"pid": (0, "1/2 diagnosis"), "time": (0, 10_000), "diag": (0, 10)},
    "medication": {"pid": (0, "1/2 medication"), "time": (0, 10_000), "med": (0, 10)},
    "password": {"id": (0, "1/10 password"), "pwd": (0, "1/50 password")},
    "taxi": {"company": (0, 1000), "fare": (0, 100), "type": (0, 20)},
    "credit_score": {"uid": (0, "1/5 credit_score"), "agency": (0, 10), "year": (2020, 2030), "cs": (300, 850)},
}

#: Columns made of others: the price of the quantity, the receipt after the shipping, the country in the phone number, names of keys, the companies' skew.
MADE: dict[str, Callable[[], Column]] = {
    "l_extendedprice": lambda: F.col("l_extendedprice") * F.col("l_quantity"),
    "l_receiptdate": lambda: F.col("l_shipdate") + F.col("l_receiptdate"),
    "c_cntrycode": lambda: idiv("c_phone", 100_000),
    "c_name": lambda: 2 * F.col("c_custkey") + 1,
    "s_name": lambda: 2 * F.col("s_suppkey") + 1,
    "n_name": lambda: 2 * F.col("n_nationkey") + 1,
    "r_name": lambda: 2 * F.col("r_regionkey") + 1,
    "ps_suppkey": lambda: F.col("ps_partkey"),
    "company": lambda: F.col("company") * F.col("company") % 1000,
}


class Bounds(NamedTuple):
    low: int
    high: int


def row_count(name: str, scale: float) -> int:
    """Rows of a table at a scale."""
    return FIXED_ROWS[name] if name in FIXED_ROWS else int(scale * ROWS[name])


def bounds(name: str, column: str, scale: float) -> Bounds | None:
    """The half-open range that a column's numbers are drawn from; None for keys and made columns."""
    rule = RANGES[name][column]
    if rule is None or rule == KEY:
        return None
    low, high = rule
    if isinstance(high, str):
        *how, other = high.split()
        n = row_count(other, scale)
        part = {"": n, "root": int(n**0.5), "2": 2 * n, "1/2": n // 2, "1/5": n // 5, "1/10": n // 10, "1/50": n // 50}[how[0] if how else ""]
        high = max(low + 1, part)
    return Bounds(low, high)


def synthetic(spark: SparkSession, name: str, scale: float, seed: int = 42) -> Table:
    """A table of ``RANGES`` at a scale."""
    rules = RANGES[name]
    key = next((c for c, rule in rules.items() if rule == KEY), None)
    row = F.col("__row")
    df = spark.range(1, row_count(name, scale) + 1).withColumnRenamed("id", "__row")
    drawn = {c: b for c in rules if (b := bounds(name, c, scale))}
    df = df.select(*([row.alias(key)] if key else []), *[uniform(b.low, b.high, seed + i, F.concat_ws("/", F.lit(name), row)).alias(c) for i, (c, b) in enumerate(drawn.items())])
    return Table(_made(df, [c for c in rules if c in MADE]).select(*rules), key)


def _made(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: MADE[c]().cast("bigint") for c in columns})
