"""The five application queries, on ``events`` as the tables' stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.sources.tables import Tables

from .registry import Registry

registry = Registry()
query = registry.query

VALUE = "CAST(round(value * 100) AS BIGINT)"


def _value() -> F.Column:
    return F.round(F.col("value") * 100).cast("bigint")


@query("SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1")
def app_password_reuse(t: Tables) -> DataFrame:
    """Credentials used more than once: equal (user, type)."""
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"SELECT user_id, CAST(MAX({VALUE}) - MIN({VALUE}) AS BIGINT) AS spread FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING MAX({VALUE}) - MIN({VALUE}) > 10000")
def app_credit_spread(t: Tables) -> DataFrame:
    """Users whose purchases are more than 100 apart."""
    rows = t.events.where(F.col("event_type") == "purchase").groupBy("user_id").agg((F.max(_value()) - F.min(_value())).alias("spread"))
    return rows.where("spread > 10000")


@query("SELECT event_type, COUNT(*) AS cnt FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def app_comorbidity(t: Tables) -> DataFrame:
    """How often each type occurs in a cohort, the customers of a market segment."""
    cohort = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return t.events.join(cohort, F.col("user_id") == F.col("c_custkey"), "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"))


@query("""
SELECT DISTINCT user_id FROM (SELECT user_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events WHERE event_type = 'error')
WHERE gap BETWEEN INTERVAL 30 HOUR AND INTERVAL 36 HOUR""")
def app_recurrence(t: Tables) -> DataFrame:
    """Users with two errors in a row that are 30 to 36 hours apart."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.where(F.col("event_type") == "error").select("user_id", (F.lead("ts").over(own) - F.col("ts")).alias("gap"))
    return rows.where(F.col("gap").between(F.expr("INTERVAL '30' HOUR"), F.expr("INTERVAL '36' HOUR"))).select("user_id").distinct()


_SOME = "event_type = 'view' AND value > 80", "event_type = 'purchase' AND value < 20"
ORDERED = f"""
SELECT COUNT(DISTINCT d.user_id) AS cnt FROM events d JOIN events m ON d.user_id = m.user_id AND d.ts <= m.ts
WHERE d.{_SOME[0].replace('AND ', 'AND d.')} AND m.{_SOME[1].replace('AND ', 'AND m.')}"""


@query(ORDERED)
def app_ordered_events(t: Tables) -> DataFrame:
    """Users with a view before a purchase: the first view is not after the last purchase."""
    first = t.events.where(_SOME[0]).groupBy("user_id").agg(F.min("ts").alias("first"))
    last = t.events.where(_SOME[1]).groupBy("user_id").agg(F.max("ts").alias("last"))
    return first.join(last, "user_id").where("first <= last").agg(F.count(F.lit(1)).alias("cnt"))


@query(ORDERED)
def app_ordered_events_by_pairs(t: Tables) -> DataFrame:
    """The same from the pairs themselves, for comparison: one semi-join per user."""
    views = t.events.where(_SOME[0]).select("user_id", "ts").alias("d")
    buys = t.events.where(_SOME[1]).select("user_id", "ts").alias("m")
    rows = views.join(buys, (F.col("d.user_id") == F.col("m.user_id")) & (F.col("d.ts") <= F.col("m.ts")), "left_semi")
    return rows.agg(F.count_distinct("user_id").alias("cnt"))
