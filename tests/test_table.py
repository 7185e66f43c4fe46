"""The dataflow API on hand-made tables: multiplicities, empty tables, nulls, ties, name clashes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomstead.functions.fixed import cents, idiv, mux, share_percent
from loomstead.operators import Predicate, Table


def table(spark, columns, *rows):
    kinds = ", ".join(f"{c} bigint" for c in columns.split())
    return Table(spark.createDataFrame(list(rows), kinds))


def values(t):
    return sorted(tuple(r) for r in t.open())


def test_inner_join_has_the_right_tables_rows(spark):
    left = table(spark, "k v", (1, 10), (2, 20), (3, 30), (4, 40))
    right = table(spark, "id w", (1, 100), (1, 200), (2, 300), (5, 400))
    out = left.inner_join("k", "id", right, expect_unique_left=True)
    assert out.columns == ["id", "v", "w"]
    assert values(out) == [(1, 10, 100), (1, 10, 200), (2, 20, 300)]


def test_a_filtered_left_row_has_no_match(spark):
    left = table(spark, "k v live", (1, 10, 1), (2, 20, 1), (3, 30, 0), (4, 40, 1)).filter_public("live", Predicate.EQUAL, 1).project("k", "v")
    right = table(spark, "id w", (1, 100), (1, 200), (2, 300), (5, 400), (6, 500), (3, 600))
    assert values(left.inner_join("k", "id", right)) == [(1, 10, 100), (1, 10, 200), (2, 20, 300)]


def test_repeated_left_keys_give_pairs_or_an_error(spark):
    left, right = table(spark, "k v", (1, 10), (1, 5), (2, 7)), table(spark, "id", (1,), (2,), (3,))
    assert values(left.inner_join("k", "id", right)) == [(1, 5), (1, 10), (2, 7)]
    with pytest.raises(Exception, match="a left key occurs twice"):
        left.inner_join("k", "id", right, expect_unique_left=True).open()


def test_join_on_two_keys(spark):
    left = table(spark, "a b v", (3, 6, 1), (5, 7, 2), (9, 8, 3))
    right = table(spark, "c d w", (3, 8, 1), (7, 3, 2), (9, 7, 3), (9, 8, 4))
    assert values(left.inner_join_multi(["a", "b"], ["c", "d"], right)) == [(9, 8, 3, 4)]


def test_clashing_names_are_an_error(spark):
    with pytest.raises(ValueError, match="both sides"):
        table(spark, "k v", (1, 1)).inner_join("k", "id", table(spark, "id v", (1, 1)))
    with pytest.raises(ValueError, match="already"):
        table(spark, "k v", (1, 1)).rename_column("k", "v")


def test_semi_and_anti_join(spark):
    left, right = table(spark, "k", (1,), (1,), (3,), (None,)), table(spark, "id", (7,), (1,), (1,), (None,))
    assert values(left.semi_join("k", "id", right)) == [(1,), (1,)]
    assert sorted(left.anti_join("k", "id", right).open(), key=str) == [(3,), (None,)]


def test_group_by_two_keys(spark):
    k1, k2 = [1, 1, 1, 2, 2, 2, 3, 3, 3, 3], [1, 1, 2, 1, 1, 2, 1, 1, 2, 2]
    t = table(spark, "a b v", *zip(k1, k2, range(1, 11), strict=True))
    out = t.group_by("a", "b").agg_sum("v", "s").agg_count("n").agg_min("v", "lo").agg_max("v", "hi").agg_avg("v", "m").table()
    assert values(out) == [(1, 1, 3, 2, 1, 2, 1), (1, 2, 3, 1, 3, 3, 3), (2, 1, 9, 2, 4, 5, 4), (2, 2, 6, 1, 6, 6, 6), (3, 1, 15, 2, 7, 8, 7), (3, 2, 19, 2, 9, 10, 9)]


def test_count_distinct_with_equal_neighbours(spark):
    t = table(spark, "g v", (1, 5), (1, 5), (1, 5), (2, 5), (2, 6), (3, 6), (3, 7))
    assert values(t.group_by("g").agg_count_distinct("v", "n").table()) == [(1, 1), (2, 2), (3, 2)]


def test_min_and_max_need_no_order(spark):
    t = table(spark, "g v", (1, 3), (1, -7), (1, 2))
    assert values(t.group_by("g").agg_min("v", "lo").agg_max("v", "hi").table()) == [(1, -7, 3)]


def test_empty_tables_and_lists(spark):
    t = table(spark, "k v")
    assert t.open() == [] and t.filter_in("k", []).open() == []
    assert values(t.group_by("k").agg_sum("v", "s").table()) == []
    assert t.aggregate(n=F.count(F.lit(1))).open() == [(0,)]
    assert table(spark, "k v", (1, 1)).filter_in("k", []).open() == []


@pytest.mark.parametrize(("p", "kept"), [(Predicate.EQUAL, [3]), (Predicate.NOT_EQUAL, [-1, 5]), (Predicate.GREATER, [5]), (Predicate.GREATER_OR_EQUAL, [3, 5]), (Predicate.LESS, [-1]), (Predicate.LESS_OR_EQUAL, [-1, 3])])
def test_predicates_are_signed_and_drop_nulls(spark, p, kept):
    t = table(spark, "v w", (-1, 3), (3, 3), (5, 3), (None, 3))
    assert [r[0] for r in values(t.filter_public("v", p, 3))] == kept
    assert [r[0] for r in values(t.filter_shared("v", "w", p))] == kept


def test_order_chain_head_and_tail(spark):
    t = table(spark, "a b", (1, 2), (2, 1), (1, 1), (2, 2)).order_by("b").order_by("a", ascending=False)
    assert [tuple(r) for r in t.open()] == [(2, 1), (2, 2), (1, 1), (1, 2)]
    assert [tuple(r) for r in t.head(2).open()] == [(2, 1), (2, 2)]
    assert [tuple(r) for r in t.tail(1).open()] == [(1, 2)]
    assert len(t.tail(9).open()) == 4
    with pytest.raises(ValueError, match="order"):
        table(spark, "a b", (1, 2)).head(1)


def test_shape(spark):
    t = table(spark, "a b c", (1, 2, 3))
    assert t.insert_column("b", F.lit(9)).columns == ["a", "b", "c"]
    assert t.rename_column("a", "z").columns == ["b", "c", "z"]
    assert t.delete_column("b").columns == ["a", "c"]
    assert t.num_columns == 3 and t.num_rows() == 1 and t.column_index("c") == 2
    with pytest.raises(KeyError):
        t.project("nope")
    with pytest.raises(KeyError):
        t.key_column()
    assert Table(t.df, "a").key_column() is not None


def test_scalar_filter(spark):
    t = table(spark, "v", (1,), (2,), (6,))
    assert values(t.filter_scalar("v", Predicate.GREATER, t.aggregate(m=idiv(F.sum("v"), F.count(F.lit(1)))).df)) == [(6,)]


def test_fixed_point(spark):
    row = spark.range(1).select(idiv(F.lit(-7), 2), cents(F.lit(12.345)), cents(F.lit(-2.5)), mux(F.lit(True), F.lit(1), 2), share_percent(F.lit(1), F.lit(3)), share_percent(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (-3, 1235, -250, 1, 33, None)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        spark.range(1).select(idiv(F.col("id"), F.col("id"))).collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(F.lit(2**62) * F.lit(4) + F.col("id")).collect()


def test_running_sum_and_lead_follow_the_order(spark):
    t = table(spark, "g k v", (1, 1, 5), (1, 2, 7), (1, 3, None), (2, 1, 4)).order_by("k")
    assert values(t.running_sum("v", "s", "g").project("g", "k", "s")) == [(1, 1, 5), (1, 2, 12), (1, 3, 12), (2, 1, 4)]
    down = t.order_by("k", ascending=False).lead("k", "next", "g").project("g", "k", "next")
    assert sorted(map(tuple, down.open()), key=str) == sorted([(1, 3, 2), (1, 2, 1), (1, 1, None), (2, 1, None)], key=str)
    assert [r.s for r in sorted(table(spark, "k v", (2, 1), (1, 3)).order_by("k").running_sum("v", "s").open())] == [3, 4]
    with pytest.raises(ValueError, match="order_by"):
        table(spark, "k", (1,)).lead("k", "n")


def test_member_flag_keeps_every_row(spark):
    left = table(spark, "k v", (1, 1), (2, 2), (2, 3), (None, 4))
    right = table(spark, "k", (2,), (2,), (None,))
    assert sorted((r.v, r.there) for r in left.member_flag("k", "k", right, "there").open()) == [(1, 0), (2, 1), (3, 1), (4, 0)]
    with pytest.raises(ValueError, match="already"):
        left.member_flag("k", "k", right, "v")


def test_filter_by_a_vector(spark):
    t = Table(table(spark, "k v", (1, 10), (2, 20), (3, 30), (4, 40)).df, "k")
    vector = Table(table(spark, "k w", (1, 10), (2, 25), (3, 5)).df, "k")
    assert values(t.filter_vector("v", Predicate.GREATER_OR_EQUAL, vector, "w")) == [(1, 10), (3, 30)]
    assert values(t.filter_vector("v", Predicate.LESS, vector, "w")) == [(2, 20)]
    with pytest.raises(Exception, match="a key occurs twice"):
        t.filter_vector("v", Predicate.LESS, Table(table(spark, "k w", (1, 10), (1, 25)).df, "k"), "w").open()
    with pytest.raises(KeyError):
        t.filter_vector("v", Predicate.LESS, Table(vector.df), "w")


def test_mask_and_printers(spark, capsys):
    t = table(spark, "k v", (1, 10), (2, None))
    assert Predicate.GREATER.open_mask(t.df, "v", 5) == [True, None]
    assert Predicate.EQUAL.open_mask(t.df, F.col("k"), 2) == [False, True]
    t.order_by("k").print_first_rows(1)
    t.print_schema()
    out = capsys.readouterr().out
    assert "only showing top 1 row" in out and "|1  |10" in out and "v: long" in out
