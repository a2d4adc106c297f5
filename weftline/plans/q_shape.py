"""Shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import shape
from weftline.plans import metadata
from weftline.plans.registry import query, table


@query("""WITH x AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey = 77 THEN 0 ELSE o_orderkey END AS b, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS pa, lag(CASE WHEN o_orderkey = 77 THEN 0 ELSE o_orderkey END) OVER (ORDER BY o_orderkey) AS pb FROM orders)
SELECT 'as it is' AS version, count(*) AS rows, count(*) FILTER (a < pa) = 0 AS ascending FROM x UNION ALL SELECT 'one fell', count(*), count(*) FILTER (b < pb) = 0 FROM x""")
def ids_ascending_check(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") == 77, 0).otherwise(F.col("o_orderkey")).alias("b"))
    check = lambda c, name: shape.is_ascending(o, c, ["o_orderkey"]).select(F.lit(name).alias("version"), "*")
    return check("a", "as it is").unionByName(check("b", "one fell"))


@query("SELECT 'price' AS column_a, 'gross' AS column_b, round(corr(l_extendedprice, l_extendedprice + l_quantity), 4) AS correlation FROM lineitem")
def correlated_pairs(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("gross"), "l_tax")
    return shape.correlated_pairs(lines, ["price", "gross", "l_tax"]).withColumn("correlation", F.round("correlation", 4))


@query("SELECT p_partkey, p_size, round(p_retailprice, 2) AS p_retailprice, NULL::int AS lost FROM part")
def restore_decimals(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("p_retailprice"))
    noisy = part.select("p_partkey", (F.col("p_size") + 0.2).alias("p_size"), (F.col("p_retailprice") + 0.0004).alias("p_retailprice"))
    out = shape.aligned(shape.restored(noisy, part), ["p_partkey", "p_size", "p_retailprice", "lost"])
    return out.withColumn("lost", F.col("lost").cast("int"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE AND event_type <> 'purchase'")
def stale_heartbeats(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return metadata.stale(e.filter("event_type <> 'purchase'"), "ts", F.lit(now), 30).select("event_id")
