"""Sources, sinks, synthetic tables, and stateless operators on a stream."""

from __future__ import annotations

from loomstead.operators import Predicate, Table
from loomstead.sources import Tables, generate, load, save, synthetic
from loomstead.sources.synthetic import RANGES, bounds, row_count


def test_save_and_load(spark, tmp_path):
    table = Table(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"))
    save(table, f"{tmp_path}/t.parquet")
    assert sorted(map(tuple, load(spark, str(tmp_path), "t").collect())) == [(1, "a"), (2, None)]
    save(table, f"{tmp_path}/p.parquet", partition_by=("k",))
    assert sorted(r.k for r in Tables(spark, str(tmp_path)).p.collect()) == [1, 2]


def test_generated_tables_are_reproducible(spark):
    a, b = (generate(spark, 50, "k", seed=3, x=(1, 10), y=(0, 2)) for _ in range(2))
    assert a.open() == b.open() and a.key == "k"
    assert all(1 <= r.x < 10 and 0 <= r.y < 2 for r in a.open()) and [r.k for r in a.open()] == list(range(1, 51))


def test_partsupp_has_many_to_many_keys(spark):
    rows = Tables(spark, "/root/testdata/sf0.001").partsupp
    assert rows.count() == rows.select("ps_partkey", "ps_suppkey").distinct().count() > rows.select("ps_partkey").distinct().count()


def test_filters_and_joins_apply_to_a_stream(spark, tmp_path):
    save(spark.createDataFrame([(1, 5), (2, 7), (3, 9)], "k long, v long"), f"{tmp_path}/in.parquet")
    stream = spark.readStream.schema("k long, v long").parquet(f"{tmp_path}/in.parquet")
    names = Table(spark.createDataFrame([(2, "two"), (3, "three")], "id long, name string"))
    kept = Table(stream).filter_public("v", Predicate.GREATER, 5)
    out = names.inner_join("id", "k", kept).project("k", "name").df
    query = out.writeStream.format("memory").queryName("joined").start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.sql("SELECT * FROM joined").collect())) == [(2, "two"), (3, "three")]
    finally:
        query.stop()


def test_synthetic_tables_are_reproducible(spark):
    for name in RANGES:
        a, b = synthetic(spark, name, 0.0001), synthetic(spark, name, 0.0001)
        assert a.columns == list(RANGES[name]) and a.num_rows() == row_count(name, 0.0001)
        assert a.df.exceptAll(b.df).count() == 0
    other = synthetic(spark, "orders", 0.0001, seed=1)
    assert other.df.exceptAll(synthetic(spark, "orders", 0.0001).df).count() > 0
    assert synthetic(spark, "customer", 0.0001).key == "c_custkey" and synthetic(spark, "taxi", 0.0001).key is None


def test_synthetic_bounds():
    assert bounds("lineitem", "l_orderkey", 0.001) == (1, 1500) and bounds("diagnosis_comorbidity", "pid", 0.001) == (0, 1000)
    assert bounds("secrecy_t1", "person", 1) == (0, 1414) and bounds("password", "pwd", 1) == (0, 100_000)
    assert bounds("orders", "o_orderkey", 1) is None and bounds("customer", "c_name", 1) is None
