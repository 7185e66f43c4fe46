"""One query for each operator of the dataflow API, on the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.functions.fixed import cents, discounted, idiv, mux, percent
from loomstead.operators import Predicate, Table
from loomstead.operators.predicate import all_of, any_of, as_bit, is_in, negative
from loomstead.sources.synthetic import RANGES, bounds, synthetic
from loomstead.sources.tables import Tables, generate, primary_key

from .registry import Registry
from .tpch import NET, PARTSUPP, PRICE, between

registry = Registry()
query = registry.query

Q = "CAST(l_quantity AS BIGINT)"


def _line(t: Tables) -> Table:
    return Table(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty"), cents("l_extendedprice").alias("price"), percent("l_discount").alias("disc"), percent("l_tax").alias("tax"), "l_returnflag"))


LINE = f"""line AS (SELECT l_orderkey, l_partkey, l_suppkey, {Q} AS qty, {PRICE} AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag FROM lineitem)"""

# -- predicates: column with constant, column with column -------------------------

for _p, _op in ((Predicate.EQUAL, "="), (Predicate.NOT_EQUAL, "<>"), (Predicate.GREATER, ">"), (Predicate.GREATER_OR_EQUAL, ">="), (Predicate.LESS, "<"), (Predicate.LESS_OR_EQUAL, "<=")):

    def _public(t: Tables, p: Predicate = _p) -> DataFrame:
        return _line(t).filter_public("qty", p, 7).project("l_orderkey", "l_partkey", "qty").df

    def _shared(t: Tables, p: Predicate = _p) -> DataFrame:
        return _line(t).filter_shared("disc", "tax", p).project("l_orderkey", "l_partkey", "disc", "tax").df

    _public.__name__, _shared.__name__ = f"filter_public_{_p.name.lower()}", f"filter_shared_{_p.name.lower()}"
    query(f"WITH {LINE} SELECT l_orderkey, l_partkey, qty FROM line WHERE qty {_op} 7")(_public)
    query(f"WITH {LINE} SELECT l_orderkey, l_partkey, disc, tax FROM line WHERE disc {_op} tax")(_shared)


@query(f"WITH {LINE} SELECT l_orderkey, qty FROM line WHERE qty IN (1, 5, 9)")
def filter_in(t: Tables) -> DataFrame:
    return _line(t).filter_in("qty", [1, 5, 9]).project("l_orderkey", "qty").df


@query(f"WITH {LINE} SELECT l_orderkey, qty FROM line WHERE false")
def filter_in_empty_list(t: Tables) -> DataFrame:
    return _line(t).filter_in("qty", []).project("l_orderkey", "qty").df


@query(f"WITH {LINE} SELECT l_orderkey, price FROM line WHERE price > (SELECT SUM(price) // COUNT(*) FROM line)")
def filter_by_scalar(t: Tables) -> DataFrame:
    line = _line(t)
    return line.filter_scalar("price", Predicate.GREATER, line.aggregate(m=idiv(F.sum("price"), F.count(F.lit(1)))).df).project("l_orderkey", "price").df


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders JOIN (SELECT l_orderkey, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE CAST(round(o_totalprice * 100) AS BIGINT) > s")
def filter_by_vector(t: Tables) -> DataFrame:
    """Orders above the sum of their own lines: one value for each row."""
    orders = Table(t.orders.select("o_orderkey", cents("o_totalprice").alias("total")), "o_orderkey")
    sums = Table(t.lineitem.groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("s")), "l_orderkey")
    return orders.filter_vector("total", Predicate.GREATER, sums, "s").df


@query(f"WITH {LINE} SELECT l_orderkey, qty, disc FROM line WHERE (qty < 5 OR qty > 45) AND NOT disc = 3 AND l_returnflag IN ('A', 'N')")
def filter_by_mask(t: Tables) -> DataFrame:
    line = _line(t)
    mask = all_of(any_of(line["qty"] < 5, line["qty"] > 45), ~(line["disc"] == 3), is_in("l_returnflag", ["A", "N"]))
    return line.filter_by(mask).project("l_orderkey", "qty", "disc").df


@query(f"WITH {LINE} SELECT l_orderkey, CAST(disc = tax AS BIGINT) AS eq, CAST(disc <> tax AS BIGINT) AS ne, CAST(disc > tax AS BIGINT) AS gt, CAST(disc >= tax AS BIGINT) AS ge, CAST(disc < tax AS BIGINT) AS lt, CAST(disc <= tax AS BIGINT) AS le, CAST(disc - 5 < 0 AS BIGINT) AS neg FROM line")
def comparison_bits(t: Tables) -> DataFrame:
    line = _line(t)
    bits = {"eq": Predicate.EQUAL, "ne": Predicate.NOT_EQUAL, "gt": Predicate.GREATER, "ge": Predicate.GREATER_OR_EQUAL, "lt": Predicate.LESS, "le": Predicate.LESS_OR_EQUAL}
    return line.df.select("l_orderkey", *[as_bit(p.shared("disc", "tax")).alias(n) for n, p in bits.items()], as_bit(negative(F.col("disc") - 5)).alias("neg"))


# -- shape ------------------------------------------------------------------------


@query(f"WITH {LINE} SELECT l_orderkey, price, qty FROM line")
def project(t: Tables) -> DataFrame:
    return _line(t).project("l_orderkey", "price", "qty").df


@query(f"WITH {LINE} SELECT l_orderkey, l_partkey, l_suppkey, qty * 2 AS qty, price, disc, l_returnflag, tax AS rate FROM line")
def insert_delete_rename(t: Tables) -> DataFrame:
    return _line(t).insert_column("qty", F.col("qty") * 2).insert_column("more", F.lit(1)).delete_column("more").rename_column("tax", "rate").df


@query(f"WITH {LINE} SELECT l_orderkey, l_partkey, l_suppkey, qty, price FROM line ORDER BY price, l_orderkey, l_partkey, l_suppkey, qty LIMIT 20")
def head(t: Tables) -> DataFrame:
    table = _line(t).project("l_orderkey", "l_partkey", "l_suppkey", "qty", "price")
    return table.order_by("qty").order_by("l_suppkey").order_by("l_partkey").order_by("l_orderkey").order_by("price").head(20).df


@query(f"WITH {LINE} SELECT l_orderkey, l_partkey, l_suppkey, qty, price FROM line ORDER BY price DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, qty DESC LIMIT 20")
def tail(t: Tables) -> DataFrame:
    table = _line(t).project("l_orderkey", "l_partkey", "l_suppkey", "qty", "price")
    return table.order_by("qty").order_by("l_suppkey").order_by("l_partkey").order_by("l_orderkey").order_by("price").tail(20).df


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def order_by_chain(t: Tables) -> DataFrame:
    """The last call counts most: every order's place among its customer's."""
    rows = Table(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", F.lit(1).cast("bigint").alias("one"))).order_by("o_orderkey").order_by("o_orderpriority", ascending=False)
    return rows.running_sum("one", "place", "o_custkey").project("o_custkey", "o_orderkey", "place")._df


@query(f"WITH {LINE} SELECT l_orderkey, l_partkey, l_suppkey, price FROM line")
def sort_all(t: Tables) -> DataFrame:
    """A total sort by two keys: a range exchange and local sorts."""
    return _line(t).project("l_orderkey", "l_partkey", "l_suppkey", "price").order_by("l_orderkey").order_by("price").df


# -- joins ------------------------------------------------------------------------


@query("SELECT s_suppkey, c_name, c_acctbal, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def inner_join(t: Tables) -> DataFrame:
    """A unique left key, checked; the right key's name stays."""
    left = Table(t.customer.select("c_custkey", "c_name", "c_acctbal"))
    return left.inner_join("c_custkey", "s_suppkey", Table(t.supplier.select("s_suppkey", "s_name")), expect_unique_left=True).df


@query("SELECT o_orderkey, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def inner_join_repeated_left_keys(t: Tables) -> DataFrame:
    """Left keys that occur several times give a row for each pair."""
    left = Table(t.lineitem.select("l_orderkey", "l_partkey"))
    return left.inner_join("l_orderkey", "o_orderkey", Table(t.orders.select("o_orderkey", "o_orderpriority"))).df


@query(f"WITH {PARTSUPP}, {LINE} SELECT l_partkey, l_suppkey, ps_supplycost, price FROM line JOIN partsupp ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey WHERE qty < 5")
def inner_join_two_keys(t: Tables) -> DataFrame:
    stock = Table(t.partsupp).project("ps_partkey", "ps_suppkey", "ps_supplycost")
    line = _line(t).filter_public("qty", Predicate.LESS, 5).project("l_partkey", "l_suppkey", "price")
    return stock.inner_join_multi(["ps_partkey", "ps_suppkey"], ["l_partkey", "l_suppkey"], line, expect_unique_left=True).df


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join(t: Tables) -> DataFrame:
    return Table(t.orders).project("o_orderkey").semi_join("o_orderkey", "l_orderkey", _line(t).filter_public("l_returnflag", Predicate.EQUAL, "R")).df


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_join(t: Tables) -> DataFrame:
    return Table(t.orders).project("o_orderkey").anti_join("o_orderkey", "l_orderkey", _line(t).filter_public("l_returnflag", Predicate.EQUAL, "R")).df


@query("SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent FROM customer")
def member_flag(t: Tables) -> DataFrame:
    """Membership as a column."""
    urgent = Table(t.orders).filter_public("o_orderpriority", Predicate.EQUAL, "1-URGENT")
    return Table(t.customer.select("c_custkey")).member_flag("c_custkey", "o_custkey", urgent, "urgent").df


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01') ON c_custkey = o_custkey")
def left_join(t: Tables) -> DataFrame:
    orders = Table(t.orders.where(between("o_orderdate", "1996-01-01", "1996-04-01")).select("o_orderkey", "o_custkey"))
    return Table(t.customer.select("c_custkey")).left_join("c_custkey", "o_custkey", orders).project("c_custkey", "o_orderkey").df


@query("SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def join_then_compare(t: Tables) -> DataFrame:
    """An inequality after an equi-join."""
    lines = Table(t.lineitem.select("l_orderkey", "l_partkey", "l_shipdate"))
    return lines.inner_join("l_orderkey", "o_orderkey", Table(t.orders.select("o_orderkey", "o_orderdate"))).filter_shared("l_shipdate", "o_orderdate", Predicate.LESS).df.select(F.col("o_orderkey").alias("l_orderkey"), "l_partkey")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join(t: Tables) -> DataFrame:
    a, b = Table(t.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("n"))), Table(t.supplier.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("m")))
    return a.inner_join("n", "m", b).filter_shared("a", "b", Predicate.LESS).project("a", "b").df


# -- aggregation --------------------------------------------------------------------


@query(f"WITH {LINE} SELECT l_returnflag, qty, CAST(SUM(price) AS BIGINT) AS s, COUNT(*) AS n, MIN(price) AS lo, MAX(price) AS hi, CAST(SUM(price) // COUNT(*) AS BIGINT) AS mean, COUNT(*) FILTER (disc > 5) AS n_disc, COUNT(DISTINCT l_suppkey) AS n_supp, CAST(SUM(CASE WHEN disc > 5 THEN price ELSE 0 END) AS BIGINT) AS s_disc FROM line GROUP BY 1, 2")
def group_by_all_aggregates(t: Tables) -> DataFrame:
    g = _line(t).group_by("l_returnflag", "qty").agg_sum("price", "s").agg_count("n").agg_min("price", "lo").agg_max("price", "hi").agg_avg("price", "mean")
    return g.agg_count_if(F.col("disc") > 5, "n_disc").agg_count_distinct("l_suppkey", "n_supp").agg_sum_if(F.col("disc") > 5, "price", "s_disc").table().df


for _name, _sql in (("count", "COUNT(*)"), ("sum", "CAST(SUM(price) AS BIGINT)"), ("min", "MIN(price)"), ("max", "MAX(price)"), ("avg", "CAST(SUM(price) // COUNT(*) AS BIGINT)"), ("count_distinct", "COUNT(DISTINCT price)")):

    def _agg(t: Tables, name: str = _name) -> DataFrame:
        g = _line(t).group_by("l_suppkey")
        return (g.agg_count("x") if name == "count" else getattr(g, f"agg_{name}")("price", "x")).table().df

    _agg.__name__ = f"agg_{_name}"
    query(f"WITH {LINE} SELECT l_suppkey, {_sql} AS x FROM line GROUP BY 1")(_agg)


@query(f"WITH {LINE} SELECT l_suppkey, COUNT(*) FILTER (qty > 25) AS x FROM line GROUP BY 1")
def agg_count_if(t: Tables) -> DataFrame:
    return _line(t).group_by("l_suppkey").agg_count_if(F.col("qty") > 25, "x").table().df


@query("SELECT o_custkey, c_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def group_by_carry(t: Tables) -> DataFrame:
    """A column that depends on the key is carried."""
    return Table(t.customer.select("c_custkey", "c_name")).inner_join("c_custkey", "o_custkey", Table(t.orders.select("o_custkey"))).group_by("o_custkey").carry("c_name").agg_count("n").table().df


@query(f"WITH {LINE} SELECT DISTINCT l_partkey, l_suppkey FROM line")
def distinct_rows(t: Tables) -> DataFrame:
    return _line(t).group_by("l_partkey", "l_suppkey").table().df


@query(f"WITH {LINE} SELECT CAST(SUM(price) AS BIGINT) AS s, COUNT(*) AS n, CAST(SUM(price) // COUNT(*) AS BIGINT) AS mean, MAX(price) AS hi, MIN(price) AS lo FROM line WHERE qty > 3")
def global_aggregates(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return _line(t).filter_public("qty", Predicate.GREATER, 3).aggregate(s=F.sum("price"), n=n, mean=idiv(F.sum("price"), n), hi=F.max("price"), lo=F.min("price")).df


@query(f"WITH {LINE} SELECT l_orderkey, CAST(SUM(qty) AS BIGINT) AS s FROM line GROUP BY 1 HAVING SUM(qty) > 150")
def having(t: Tables) -> DataFrame:
    return _line(t).group_by("l_orderkey").agg_sum("qty", "s").table().filter_public("s", Predicate.GREATER, 150).df


# -- windows, arithmetic ----------------------------------------------------------


@query("SELECT user_id, event_id, CAST(SUM(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events")
def prefix_sum(t: Tables) -> DataFrame:
    events = Table(t.events.select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents")))
    return events.order_by("event_id").order_by("ts").running_sum("cents", "running", "user_id").project("user_id", "event_id", "running")._df


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events")
def next_row(t: Tables) -> DataFrame:
    return Table(t.events.select("user_id", "event_id", "ts")).order_by("event_id").order_by("ts").lead("event_id", "next", "user_id").project("user_id", "event_id", "next")._df


@query("SELECT user_id, event_id, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS then FROM events")
def row_after_next(t: Tables) -> DataFrame:
    """Two rows on, the latest first."""
    return Table(t.events.select("user_id", "event_id", "ts")).order_by("event_id").order_by("ts", ascending=False).lead("event_id", "then", "user_id", offset=2).project("user_id", "event_id", "then")._df


@query(f"WITH {LINE} SELECT l_orderkey, price + qty AS a, price + 7 AS b, price - qty AS c, -price AS d, price * 3 AS e, price * qty AS f, price // 7 AS g, price // (qty + 1) AS h, -price // 7 AS i, -price % 7 AS j FROM line")
def arithmetic(t: Tables) -> DataFrame:
    p, q = F.col("price"), F.col("qty")
    return _line(t).df.select("l_orderkey", (p + q).alias("a"), (p + 7).alias("b"), (p - q).alias("c"), (-p).alias("d"), (p * 3).alias("e"), (p * q).alias("f"), idiv(p, 7).alias("g"), idiv(p, q + 1).alias("h"), idiv(-p, 7).alias("i"), (-p % 7).alias("j"))


@query(f"WITH {LINE} SELECT l_orderkey, CASE WHEN qty > 20 THEN price ELSE 0 END AS x, qty & disc AS a, qty | disc AS o, xor(qty, disc) AS e, qty << 2 AS l, qty >> 2 AS r FROM line")
def mux_and_bits(t: Tables) -> DataFrame:
    q, d = F.col("qty"), F.col("disc")
    return _line(t).df.select("l_orderkey", mux(q > 20, F.col("price"), 0).alias("x"), q.bitwiseAND(d).alias("a"), q.bitwiseOR(d).alias("o"), q.bitwiseXOR(d).alias("e"), F.shiftleft(q, 2).alias("l"), F.shiftright(q, 2).alias("r"))


@query("SELECT p_partkey, substr(p_brand, 7) AS brand_no, p_type LIKE '%O%' AS has_o FROM part")
def strings(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.substring("p_brand", 7, 100).alias("brand_no"), F.col("p_type").like("%O%").alias("has_o"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders")
def extract_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"))


# -- set operations, sources ----------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query(f"WITH {PARTSUPP} SELECT ps_partkey, ps_suppkey, ps_supplycost, ps_availqty FROM partsupp")
def derived_partsupp(t: Tables) -> DataFrame:
    return t.partsupp.select("ps_partkey", "ps_suppkey", "ps_supplycost", "ps_availqty")


@query("SELECT CAST(i AS BIGINT) AS k FROM range(1, 1001) r(i)")
def generated_key(t: Tables) -> DataFrame:
    return primary_key(1000, "k", t.spark)


@query("SELECT 1000::BIGINT AS n, true AS in_range, 1000::BIGINT AS n_keys")
def generated_table(t: Tables) -> DataFrame:
    made = generate(t.spark, 1000, "k", a=(3, 9), b=(1, 100)).df
    return made.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("a").between(3, 8) & F.col("b").between(1, 99)).alias("in_range"), F.count_distinct("k").alias("n_keys"))


SCALE = 0.0005
#: Rows at ``SCALE``.
COUNTS = (
    "('lineitem', 3000), ('orders', 750), ('customer', 75), ('part', 100), ('supplier', 5), ('partsupp', 400), ('nation', 25), ('region', 5), "
    "('secrecy_r', 1000), ('secrecy_s', 1500), ('secrecy_t1', 1000), ('secrecy_t2', 500), ('secrecy_t3', 500), ('cohort', 250), ('diagnosis_comorbidity', 2500), "
    "('diagnosis', 1500), ('medication', 1000), ('password', 2500), ('taxi', 2500), ('credit_score', 2500)"
)


@query(f"SELECT t AS name, CAST(n AS BIGINT) AS n, true AS in_range FROM (VALUES {COUNTS}) v(t, n)")
def synthetic_tables(t: Tables) -> DataFrame:
    """Every synthetic table: its rows, and whether all drawn columns keep to their ranges."""
    made = {"l_extendedprice", "l_receiptdate"}
    out = []
    for name in RANGES:
        drawn = {c: b for c in RANGES[name] if c not in made and (b := bounds(name, c, SCALE))}
        ok = all_of(*[F.col(c).between(b.low, b.high - 1) for c, b in drawn.items()])
        out.append(synthetic(t.spark, name, SCALE).df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("in_range")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT 3000 AS n, 3000 AS prices, 3000 AS receipts, 75 AS codes")
def synthetic_made_columns(t: Tables) -> DataFrame:
    """Columns made of others agree with them."""
    line, customer = synthetic(t.spark, "lineitem", SCALE).df, synthetic(t.spark, "customer", SCALE).df
    price = F.col("l_extendedprice").between(90 * F.col("l_quantity"), 110 * F.col("l_quantity")) & (F.col("l_extendedprice") % F.col("l_quantity") == 0)
    receipt = (F.col("l_receiptdate") - F.col("l_shipdate")).between(1, 29)
    codes = customer.agg(F.count_if(F.col("c_cntrycode") == idiv("c_phone", 100_000)).cast("int").alias("codes"))
    return line.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(price).cast("int").alias("prices"), F.count_if(receipt).cast("int").alias("receipts")).crossJoin(codes)


@query(f"SELECT l_orderkey, CAST(SUM({NET}) AS BIGINT) AS net FROM lineitem GROUP BY 1")
def fixed_point_net(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(discounted()).alias("net"))
