"""Extensions beyond the layered retrieval itself: event-time windows, grouping sets, set operations, ranking, sketches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.plans.base import Listing
from lamella.sources.tables import table
from lamella.streaming import windows

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql


@listing.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, sf_dir):
    """Hourly counts and sums of each type, by the function the stream uses."""
    return windows.window_counts(table(spark, sf_dir, "events"), "1 hour")


@listing.add("""WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS fresh FROM events),
s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, sf_dir):
    """Sessions of each user, closed after half an hour."""
    return windows.sessions(table(spark, sf_dir, "events"), "30 minutes")


@listing.add("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INTEGER * 2 + grouping(l_linestatus)::INTEGER AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, sf_dir):
    """Counts over every combination of two flags."""
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


@listing.add("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def ext_set_operations(spark, sf_dir):
    """Customers with open and pending but no urgent orders."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    of = lambda c: o.where(c).select(F.col("o_custkey").alias("k"))
    return of("o_orderstatus = 'O'").intersect(of("o_orderstatus = 'P'")).subtract(of("o_orderpriority = '1-URGENT'"))


@listing.add("""SELECT n_name, o_custkey, spent, rank() OVER (PARTITION BY n_name ORDER BY spent DESC)::INTEGER AS place FROM (
SELECT n_name, o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) QUALIFY place <= 5""")
def ext_ranking(spark, sf_dir):
    """The five best customers of each nation."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = o.join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.withColumn("place", F.rank().over(Window.partitionBy("n_name").orderBy(F.desc("spent")))).where("place <= 5").select("n_name", "o_custkey", "spent", "place")


@listing.add()
def ext_approx_distinct(spark, sf_dir):
    """Approximate distinct users of each type; a sketch, so no SQL twin."""
    return table(spark, sf_dir, "events", "event_type", "user_id").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))
