"""Every relational query against DuckDB on small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomstead.plans import apps, operator_queries, tpch

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
REGISTRIES = (tpch.registry, apps.registry, operator_queries.registry)
ENTRIES = {k: f for r in REGISTRIES for k, f in r.entries().items()}
SQL = {k: s for r in REGISTRIES for k, s in r.sql.items()}
#: Parameters select nothing at this size.
MAY_BE_EMPTY = {"filter_in_empty_list"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(v[i]) for i in order) for v in values))


@pytest.mark.parametrize("name", ENTRIES)
def test_query_matches_sql(spark, duck, name):
    df = ENTRIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    relation = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, got) == rows(relation.columns, relation.fetchall())
    assert got or name in MAY_BE_EMPTY


def test_half_of_the_queries_push_filters_down(spark):
    plan = ENTRIES["tpch_q6"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "l_orderkey" not in plan


@pytest.mark.parametrize("name", ["tpch_q2", "tpch_q9", "tpch_q16"])
def test_offers_are_cut_to_the_parts_below_their_aggregate(spark, name):
    plan = ENTRIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Aggregate [l_partkey" in line or "Aggregate [ps_partkey" in line)
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert any("Join LeftSemi" in line for line in below)


def test_discount_bounds_reach_the_scan(spark):
    plan = ENTRIES["tpch_q6"](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "l_discount#" in plan and ">= 0.04)" in plan
