"""The 22 decision-support queries.

Money is in cents, rates in percent, divisions are truncated, so that results
are exact.  The tables at hand lack some columns of the benchmark; where a query
needs one, a stand-in is named in its docstring.  ``partsupp`` is derived from
the order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.fixed import cents, charged, discounted, idiv, percent, share_percent
from loomstead.sources.tables import Tables

from .registry import Registry

registry = Registry()
query = registry.query

PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT)"
DISC = "CAST(round(l_discount * 100) AS BIGINT)"
TAX = "CAST(round(l_tax * 100) AS BIGINT)"
NET = f"({PRICE} * (100 - {DISC}) // 100)"
PARTSUPP = f"""partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, MIN({PRICE} // greatest(CAST(l_quantity AS BIGINT), 1)) AS ps_supplycost,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ps_availqty
  FROM lineitem GROUP BY 1, 2)"""
LATE_SQL = "l_shipdate > o_orderdate + INTERVAL 60 DAY"


def ts(text: str) -> F.Column:
    """A timestamp without a time zone, as the tables have them."""
    return F.lit(text).cast("timestamp_ntz")


def between(column: str, start: str, end: str) -> F.Column:
    """From ``start`` to before ``end``."""
    return (F.col(column) >= ts(start)) & (F.col(column) < ts(end))


def late() -> F.Column:
    """Stands in for a receipt after the committed date: shipped over 60 days after the order."""
    return F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL '60' DAY")


def _year(column: str) -> F.Column:
    return F.year(column).cast("bigint")


@query(f"""
SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(SUM({PRICE}) AS BIGINT) AS sum_base_price,
       CAST(SUM({NET}) AS BIGINT) AS sum_disc_price, CAST(SUM({NET} * (100 + {TAX}) // 100) AS BIGINT) AS sum_charge,
       CAST(SUM(CAST(l_quantity AS BIGINT)) // COUNT(*) AS BIGINT) AS avg_qty, CAST(SUM({PRICE}) // COUNT(*) AS BIGINT) AS avg_price,
       CAST(SUM({DISC}) // COUNT(*) AS BIGINT) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""")
def tpch_q1(t: Tables) -> DataFrame:
    qty, price, disc, n = F.col("l_quantity").cast("bigint"), cents("l_extendedprice"), percent("l_discount"), F.count(F.lit(1))
    return (
        t.lineitem.where(F.col("l_shipdate") <= ts("1998-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(qty).alias("sum_qty"), F.sum(price).alias("sum_base_price"), F.sum(discounted()).alias("sum_disc_price"), F.sum(charged()).alias("sum_charge"),
            idiv(F.sum(qty), n).alias("avg_qty"), idiv(F.sum(price), n).alias("avg_price"), idiv(F.sum(disc), n).alias("avg_disc"), n.alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def _of_parts(t: Tables, parts: DataFrame) -> DataFrame:
    """``partsupp`` of some parts; the semi-join is on a grouping key and goes below the aggregate."""
    return t.partsupp.join(parts.select(F.col("p_partkey").alias("__part")), F.col("ps_partkey") == F.col("__part"), "left_semi")


def _offers(t: Tables, region: str, parts: DataFrame) -> DataFrame:
    places = t.region.where(F.col("r_name") == region).join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    offers = _of_parts(t, parts).join(suppliers.select(F.col("s_suppkey").alias("__supp")), F.col("ps_suppkey") == F.col("__supp"), "left_semi")
    return offers.join(suppliers, F.col("ps_suppkey") == F.col("s_suppkey"))


Q2 = f"""
WITH {PARTSUPP},
offers AS (SELECT * FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost FROM part JOIN offers o ON p_partkey = ps_partkey
WHERE p_size = 15 AND p_type LIKE '%O%' AND ps_supplycost = (SELECT MIN(i.ps_supplycost) FROM offers i WHERE i.ps_partkey = p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey"""


@query(Q2)
def tpch_q2(t: Tables) -> DataFrame:
    parts = t.part.where((F.col("p_size") == 15) & F.col("p_type").like("%O%")).select("p_partkey")
    best = F.min("ps_supplycost").over(Window.partitionBy("ps_partkey"))
    rows = _offers(t, "ASIA", parts).withColumn("best", best).where("ps_supplycost = best")
    return rows.select("s_acctbal", "s_name", "n_name", F.col("ps_partkey").alias("p_partkey"), "ps_supplycost").orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey")


@query(Q2)
def tpch_q2_written_order(t: Tables) -> DataFrame:
    """The same, joined in the order in which the SQL names the tables; offers are not cut to the parts first."""
    offers = t.partsupp.join(t.supplier, F.col("ps_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name") == "ASIA")
    best = F.min("ps_supplycost").over(Window.partitionBy("ps_partkey"))
    parts = t.part.where((F.col("p_size") == 15) & F.col("p_type").like("%O%"))
    rows = parts.join(offers, F.col("p_partkey") == F.col("ps_partkey")).withColumn("best", best).where("ps_supplycost = best")
    return rows.select("s_acctbal", "s_name", "n_name", "p_partkey", "ps_supplycost").orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey")


@query(f"""
SELECT l_orderkey, CAST(SUM({NET}) AS BIGINT) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate""")
def tpch_q3(t: Tables) -> DataFrame:
    """The order's date depends on its key and is carried, not grouped."""
    buyers = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = t.orders.where(F.col("o_orderdate") < ts("1998-03-15")).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = t.lineitem.where(F.col("l_shipdate") > ts("1998-03-15"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey").agg(F.sum(discounted()).alias("revenue"), F.max("o_orderdate").alias("o_orderdate")).orderBy(F.desc("revenue"), "o_orderdate")


Q4 = f"""
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND {LATE_SQL})
GROUP BY 1 ORDER BY 1"""


@query(Q4)
def tpch_q4(t: Tables) -> DataFrame:
    """The late line is the 60-day stand-in."""
    orders = t.orders.where(between("o_orderdate", "1996-01-01", "1996-04-01"))
    rows = orders.join(t.lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & late(), "left_semi")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority")


@query(Q4)
def tpch_q4_without_semi_join(t: Tables) -> DataFrame:
    """The same by an inner join and distinct orders, for comparison."""
    orders = t.orders.where(between("o_orderdate", "1996-01-01", "1996-04-01"))
    rows = orders.join(t.lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & late()).select("o_orderkey", "o_orderpriority").distinct()
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority")


Q5 = f"""
SELECT n_name, CAST(SUM({NET}) AS BIGINT) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1"""


@query(Q5)
def tpch_q5(t: Tables) -> DataFrame:
    """Smallest tables first, in two branches that meet at the order lines."""
    nations = t.region.where(F.col("r_name") == "ASIA").join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    suppliers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    orders = t.orders.where(between("o_orderdate", "1996-01-01", "1997-01-01")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = t.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(F.sum(discounted()).alias("revenue")).orderBy(F.desc("revenue"))


@query(Q5)
def tpch_q5_written_order(t: Tables) -> DataFrame:
    """The same, joined in the order in which the SQL names the tables."""
    rows = t.customer.join(t.orders.where(between("o_orderdate", "1996-01-01", "1997-01-01")), F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t.region.where(F.col("r_name") == "ASIA"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.sum(discounted()).alias("revenue")).orderBy(F.desc("revenue"))


def _q6(t: Tables, discount: F.Column) -> DataFrame:
    # The wide bounds say nothing new, but reach the scan.
    wide = F.col("l_discount").between(0.04, 0.08)
    rows = t.lineitem.where(between("l_shipdate", "1996-01-01", "1997-01-01") & wide & discount & (F.col("l_quantity") < 24))
    return rows.agg(F.coalesce(F.sum(idiv(cents("l_extendedprice") * percent("l_discount"), 100)), F.lit(0)).alias("revenue"))


def _q6_sql(discount: str) -> str:
    return f"SELECT CAST(coalesce(SUM({PRICE} * {DISC} // 100), 0) AS BIGINT) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND {discount} AND l_quantity < 24"


@query(_q6_sql(f"{DISC} BETWEEN 5 AND 7"))
def tpch_q6(t: Tables) -> DataFrame:
    return _q6(t, percent("l_discount").between(5, 7))


@query(_q6_sql(f"{DISC} >= 5 AND {DISC} < 7"))
def tpch_q6_half_open(t: Tables) -> DataFrame:
    """With the upper discount excluded."""
    return _q6(t, (percent("l_discount") >= 5) & (percent("l_discount") < 7))


@query(_q6_sql(f"{DISC} - 5 >= 0 AND {DISC} - 8 < 0"))
def tpch_q6_by_sign(t: Tables) -> DataFrame:
    """Bounds as signs of differences."""
    return _q6(t, ~(percent("l_discount") - 5 < 0) & (percent("l_discount") - 8 < 0))


Q7 = f"""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, CAST(SUM({NET}) AS BIGINT) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
  AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
GROUP BY 1, 2, 3"""


@query(Q7)
def tpch_q7(t: Tables) -> DataFrame:
    two = t.nation.where(F.col("n_name").isin("NATION_1", "NATION_2"))
    suppliers = t.supplier.join(two.select("n_nationkey", F.col("n_name").alias("supp_nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "supp_nation")
    buyers = t.customer.join(two.select("n_nationkey", F.col("n_name").alias("cust_nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "cust_nation")
    orders = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation")
    lines = t.lineitem.where(between("l_shipdate", "1995-01-01", "1997-01-01")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("supp_nation") != F.col("cust_nation")))
    return rows.groupBy("supp_nation", "cust_nation", _year("l_shipdate").alias("l_year")).agg(F.sum(discounted()).alias("revenue")).orderBy("supp_nation", "cust_nation", "l_year")


@query(Q7)
def tpch_q7_written_order(t: Tables) -> DataFrame:
    """The same, joined in the order in which the SQL names the tables."""
    n1, n2 = t.nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("supp_nation")), t.nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("cust_nation"))
    rows = t.supplier.join(t.lineitem.where(between("l_shipdate", "1995-01-01", "1997-01-01")), F.col("s_suppkey") == F.col("l_suppkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(n1, F.col("s_nationkey") == F.col("k1")).join(n2, F.col("c_nationkey") == F.col("k2"))
    rows = rows.where(F.col("supp_nation").isin("NATION_1", "NATION_2") & F.col("cust_nation").isin("NATION_1", "NATION_2") & (F.col("supp_nation") != F.col("cust_nation")))
    return rows.groupBy("supp_nation", "cust_nation", _year("l_shipdate").alias("l_year")).agg(F.sum(discounted()).alias("revenue")).orderBy("supp_nation", "cust_nation", "l_year")


Q8 = f"""
WITH v AS (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {NET} AS volume, n2.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND p_type = 'ECONOMY')
SELECT o_year, CAST(100 * SUM(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) // nullif(SUM(volume), 0) AS BIGINT) AS mkt_share FROM v GROUP BY 1"""


@query(Q8)
def tpch_q8(t: Tables) -> DataFrame:
    """The share in whole percent."""
    asia = t.region.where(F.col("r_name") == "ASIA").join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    buyers = t.customer.join(asia, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    orders = t.orders.where(between("o_orderdate", "1995-01-01", "1997-01-01")).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    parts = t.part.where(F.col("p_type") == "ECONOMY").select("p_partkey")
    rows = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    own = F.sum(F.when(F.col("nation") == "NATION_2", discounted()).otherwise(0))
    return rows.groupBy(_year("o_orderdate").alias("o_year")).agg(share_percent(own, F.sum(discounted())).alias("mkt_share")).orderBy("o_year")


@query(Q8)
def tpch_q8_written_order(t: Tables) -> DataFrame:
    """The same, joined in the order in which the SQL names the tables."""
    n1, n2 = t.nation.select(F.col("n_nationkey").alias("k1"), "n_regionkey"), t.nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("nation"))
    rows = t.part.where(F.col("p_type") == "ECONOMY").join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(t.orders.where(between("o_orderdate", "1995-01-01", "1997-01-01")), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(n1, F.col("c_nationkey") == F.col("k1")).join(t.region.where(F.col("r_name") == "ASIA"), F.col("n_regionkey") == F.col("r_regionkey")).join(n2, F.col("s_nationkey") == F.col("k2"))
    own = F.sum(F.when(F.col("nation") == "NATION_2", discounted()).otherwise(0))
    return rows.groupBy(_year("o_orderdate").alias("o_year")).agg(share_percent(own, F.sum(discounted())).alias("mkt_share")).orderBy("o_year")


Q9 = f"""
WITH {PARTSUPP}
SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, CAST(SUM({NET} - ps_supplycost * CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey
JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%blue%' GROUP BY 1, 2"""


@query(Q9)
def tpch_q9(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_name").like("%blue%")).select("p_partkey")
    lines = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    rows = lines.join(_of_parts(t, parts), (F.col("ps_suppkey") == F.col("l_suppkey")) & (F.col("ps_partkey") == F.col("l_partkey"))).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    profit = discounted() - F.col("ps_supplycost") * F.col("l_quantity").cast("bigint")
    return rows.groupBy("nation", _year("o_orderdate").alias("o_year")).agg(F.sum(profit).alias("sum_profit")).orderBy("nation", F.desc("o_year"))


@query(Q9)
def tpch_q9_written_order(t: Tables) -> DataFrame:
    """The same, joined in the order in which the SQL names the tables."""
    rows = t.part.where(F.col("p_name").like("%blue%")).join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(t.partsupp, (F.col("ps_suppkey") == F.col("l_suppkey")) & (F.col("ps_partkey") == F.col("l_partkey"))).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    profit = discounted() - F.col("ps_supplycost") * F.col("l_quantity").cast("bigint")
    return rows.groupBy(F.col("n_name").alias("nation"), _year("o_orderdate").alias("o_year")).agg(F.sum(profit).alias("sum_profit")).orderBy("nation", F.desc("o_year"))


Q10 = f"""
SELECT c_custkey, c_name, CAST(SUM({NET}) AS BIGINT) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name"""


@query(Q10)
def tpch_q10(t: Tables) -> DataFrame:
    """Lines are summed by customer before the customer's columns are joined."""
    orders = t.orders.where(between("o_orderdate", "1996-01-01", "1996-04-01")).select("o_orderkey", "o_custkey")
    sums = t.lineitem.where(F.col("l_returnflag") == "R").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum(discounted()).alias("revenue"))
    rows = t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(F.desc("revenue"))


@query(Q10)
def tpch_q10_written_order(t: Tables) -> DataFrame:
    """The same, joined in the order in which the SQL names the tables, and grouped by all of the customer's columns."""
    rows = t.customer.join(t.orders.where(between("o_orderdate", "1996-01-01", "1996-04-01")), F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem.where(F.col("l_returnflag") == "R"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(F.sum(discounted()).alias("revenue")).orderBy(F.desc("revenue"))


@query(f"""
WITH {PARTSUPP},
v AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS value FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')
SELECT ps_partkey, CAST(SUM(value) AS BIGINT) AS value FROM v GROUP BY 1 HAVING SUM(value) > (SELECT SUM(value) // 1000 FROM v)""")
def tpch_q11(t: Tables) -> DataFrame:
    """Over a thousandth of the nation's stock."""
    suppliers = t.supplier.join(t.nation.where(F.col("n_name") == "NATION_7"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")
    values = t.partsupp.join(suppliers, F.col("ps_suppkey") == F.col("s_suppkey"), "left_semi").groupBy("ps_partkey").agg(F.sum(F.col("ps_supplycost") * F.col("ps_availqty")).alias("value"))
    limit = values.agg(idiv(F.sum("value"), 1000)).scalar()
    return values.where(F.col("value") > limit).orderBy(F.desc("value"))


@query(f"""
SELECT l_returnflag, COUNT(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count, COUNT(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND {LATE_SQL} AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def tpch_q12(t: Tables) -> DataFrame:
    """The return flag stands in for the ship mode, the 60-day rule for the dates."""
    lines = t.lineitem.where(F.col("l_returnflag").isin("A", "R") & between("l_shipdate", "1996-01-01", "1997-01-01"))
    rows = lines.join(t.orders, (F.col("l_orderkey") == F.col("o_orderkey")) & late())
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return rows.groupBy("l_returnflag").agg(F.count_if(high).alias("high_line_count"), F.count_if(~high).alias("low_line_count")).orderBy("l_returnflag")


def _q13_sql(how: str) -> str:
    return f"""
WITH c AS (
  SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer {how} JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT c_count, COUNT(*) AS custdist FROM c GROUP BY 1"""


def _q13(t: Tables, how: str) -> DataFrame:
    orders = t.orders.where((F.col("o_orderpriority") != "1-URGENT") & between("o_orderdate", "1996-01-01", "1997-01-01"))
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), how).select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return rows.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


@query(_q13_sql("LEFT"))
def tpch_q13(t: Tables) -> DataFrame:
    """Priority and year stand in for the comment; customers without an order count as 0."""
    return _q13(t, "left")


@query(_q13_sql(""))
def tpch_q13_inner(t: Tables) -> DataFrame:
    """Without the customers that have no such order."""
    return _q13(t, "inner")


@query(f"""
SELECT CAST(100 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END) // nullif(SUM({NET}), 0) AS BIGINT) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01'""")
def tpch_q14(t: Tables) -> DataFrame:
    """In whole percent."""
    rows = t.lineitem.where(between("l_shipdate", "1996-03-01", "1996-04-01")).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.agg(share_percent(F.sum(F.when(F.col("p_type").like("PROMO%"), discounted()).otherwise(0)), F.sum(discounted())).alias("promo_revenue"))


@query(f"""
WITH r AS (SELECT l_suppkey, CAST(SUM({NET}) AS BIGINT) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT MAX(total_revenue) FROM r)""")
def tpch_q15(t: Tables) -> DataFrame:
    revenue = t.lineitem.where(between("l_shipdate", "1996-01-01", "1996-04-01")).groupBy("l_suppkey").agg(F.sum(discounted()).alias("total_revenue"))
    best = revenue.where(F.col("total_revenue") == revenue.agg(F.max("total_revenue")).scalar())
    return t.supplier.join(best, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


@query(f"""
WITH {PARTSUPP}
SELECT p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#10' AND p_type NOT LIKE 'PROMO%' AND p_size IN (1, 2, 3, 4, 5, 6, 7, 8) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY 1, 2, 3""")
def tpch_q16(t: Tables) -> DataFrame:
    """A negative balance stands in for the complaint."""
    parts = t.part.where((F.col("p_brand") != "Brand#10") & ~F.col("p_type").like("PROMO%") & F.col("p_size").isin(*range(1, 9)))
    bad = t.supplier.where(F.col("s_acctbal") < 0).select("s_suppkey")
    # A part and its supplier are one row each, but parts of one kind may share a supplier.
    rows = _of_parts(t, parts).join(bad, F.col("ps_suppkey") == F.col("s_suppkey"), "left_anti").join(parts, F.col("ps_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand", "p_type", F.col("p_size").cast("bigint").alias("p_size")).agg(F.count_distinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


@query(f"""
SELECT CAST(coalesce(SUM({PRICE}), 0) // 7 AS BIGINT) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#10' AND 5 * CAST(l_quantity AS BIGINT) * (SELECT COUNT(*) FROM lineitem i WHERE i.l_partkey = p_partkey) < (SELECT SUM(CAST(l_quantity AS BIGINT)) FROM lineitem i WHERE i.l_partkey = p_partkey)""")
def tpch_q17(t: Tables) -> DataFrame:
    """Lines below a fifth of their part's mean quantity, compared without rounding; no container."""
    parts = t.part.where(F.col("p_brand") == "Brand#10").select("p_partkey")
    own, qty = Window.partitionBy("l_partkey"), F.col("l_quantity").cast("bigint")
    rows = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_extendedprice", qty.alias("q"), F.sum(qty).over(own).alias("s"), F.count(F.lit(1)).over(own).alias("n"))
    return rows.where(5 * F.col("q") * F.col("n") < F.col("s")).agg(idiv(F.coalesce(F.sum(cents("l_extendedprice")), F.lit(0)), 7).alias("avg_yearly"))


@query("""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_quantity
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING SUM(CAST(l_quantity AS BIGINT)) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice""")
def tpch_q18(t: Tables) -> DataFrame:
    """The lines are summed once; the sum is what the outer query would sum again."""
    big = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sum_quantity")).where("sum_quantity > 200")
    rows = t.orders.join(big, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_quantity").orderBy(F.desc("o_totalprice"), "o_orderdate")


@query(f"""
SELECT CAST(coalesce(SUM({NET}), 0) AS BIGINT) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND p_type = 'SMALL' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#23' AND p_type = 'MEDIUM' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#14' AND p_type = 'LARGE' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""")
def tpch_q19(t: Tables) -> DataFrame:
    """The type stands in for the container."""
    rules = (("Brand#12", "SMALL", 1, 11, 15), ("Brand#23", "MEDIUM", 10, 20, 30), ("Brand#14", "LARGE", 20, 30, 45))
    part = line = F.lit(False)
    for brand, kind, low, high, most in rules:
        own = (F.col("p_brand") == brand) & (F.col("p_type") == kind) & F.col("p_size").between(1, most)
        part, line = part | own, line | (own & F.col("l_quantity").between(low, high))
    rows = t.lineitem.where(F.col("l_quantity").between(1, 30)).join(t.part.where(part), F.col("l_partkey") == F.col("p_partkey"))
    return rows.where(line).agg(F.coalesce(F.sum(discounted()), F.lit(0)).alias("revenue"))


@query(f"""
WITH {PARTSUPP}
SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name = 'NATION_7' AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%')
    AND 2 * ps_availqty > (SELECT SUM(CAST(l_quantity AS BIGINT)) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'))""")
def tpch_q20(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_name").like("blue%")).select("p_partkey")
    sold = t.lineitem.where(between("l_shipdate", "1996-01-01", "1997-01-01")).groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sold"))
    stock = t.partsupp.join(parts, F.col("ps_partkey") == F.col("p_partkey"), "left_semi")
    enough = stock.join(sold, (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey"))).where(2 * F.col("ps_availqty") > F.col("sold")).select("ps_suppkey")
    here = t.supplier.join(t.nation.where(F.col("n_name") == "NATION_7"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return here.join(enough, F.col("s_suppkey") == F.col("ps_suppkey"), "left_semi").select("s_suppkey", "s_name").orderBy("s_name")


@query(f"""
WITH l AS (SELECT l_orderkey, l_suppkey, {LATE_SQL} AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT s_name, COUNT(*) AS numwait FROM supplier JOIN l l1 ON s_suppkey = l1.l_suppkey
WHERE l1.late AND EXISTS (SELECT * FROM l l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM l l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.late)
GROUP BY 1""")
def tpch_q21(t: Tables) -> DataFrame:
    """One pass by order: several suppliers, only one of them late (60-day stand-in); all nations."""
    rows = t.lineitem.join(t.orders.where(F.col("o_orderstatus") == "F"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", late().alias("late"))
    per = rows.groupBy("l_orderkey", "l_suppkey").agg(F.count_if("late").alias("late"))
    orders = per.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("late") > 0).alias("n_late"), F.max(F.when(F.col("late") > 0, F.struct("l_suppkey", "late"))).alias("who"))
    waits = orders.where("n > 1 AND n_late = 1").groupBy(F.col("who.l_suppkey").alias("k")).agg(F.sum("who.late").alias("numwait"))
    return t.supplier.join(waits, F.col("s_suppkey") == F.col("k")).groupBy("s_name").agg(F.sum("numwait").alias("numwait")).orderBy(F.desc("numwait"), "s_name")


@query(f"""
WITH l AS (SELECT l_orderkey, l_suppkey, {LATE_SQL} AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
o AS (SELECT l_orderkey FROM l GROUP BY 1 HAVING COUNT(*) > 1 AND COUNT(*) FILTER (late) = 1)
SELECT s_name, COUNT(*) AS numwait FROM l JOIN o USING (l_orderkey) JOIN supplier ON s_suppkey = l_suppkey WHERE late GROUP BY 1""")
def tpch_q21_by_lines(t: Tables) -> DataFrame:
    """Counting lines instead of distinct suppliers."""
    rows = t.lineitem.join(t.orders.where(F.col("o_orderstatus") == "F"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", late().alias("late"))
    orders = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.max(F.when(F.col("late"), F.col("l_suppkey"))).alias("k"))
    waits = orders.where("n > 1 AND n_late = 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return t.supplier.join(waits, F.col("s_suppkey") == F.col("k")).groupBy("s_name").agg(F.sum("n").alias("numwait")).orderBy(F.desc("numwait"), "s_name")


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13))
SELECT CAST(c_nationkey AS BIGINT) AS cntrycode, COUNT(*) AS numcust, CAST(SUM(bal) AS BIGINT) AS totacctbal FROM c
WHERE bal > (SELECT SUM(bal) // COUNT(*) FROM c WHERE bal > 0) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01')
GROUP BY 1""")
def tpch_q22(t: Tables) -> DataFrame:
    """The nation stands in for the country code; orders of one year, as every customer has some order."""
    some = t.customer.where(F.col("c_nationkey").isin(1, 3, 5, 7, 9, 11, 13)).select("c_custkey", "c_nationkey", cents("c_acctbal").alias("bal"))
    mean = some.where("bal > 0").agg(idiv(F.sum("bal"), F.count(F.lit(1)))).scalar()
    rows = some.where(F.col("bal") > mean).join(t.orders.where(between("o_orderdate", "1996-01-01", "1997-01-01")), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rows.groupBy(F.col("c_nationkey").cast("bigint").alias("cntrycode")).agg(F.count(F.lit(1)).alias("numcust"), F.sum("bal").alias("totacctbal")).orderBy("cntrycode")
