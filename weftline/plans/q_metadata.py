"""Metadata queries: orders and events play runs and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans import metadata
from weftline.plans.registry import query, table


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def newest_per_key(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return metadata.newest_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("""WITH e AS (SELECT event_id AS id, user_id, floor(epoch(ts))::bigint AS t FROM events), p AS (SELECT a.id, b.id AS peer_id, abs(a.t - b.t) AS g, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.t - b.t), abs(a.id - b.id), b.id DESC) AS rn FROM e a JOIN e b ON a.user_id = b.user_id AND a.id <> b.id)
SELECT id, peer_id, g AS gap_seconds FROM p WHERE rn = 1""")
def nearest_time_peer(spark, d):
    return metadata.nearest_peer(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("""SELECT event_type, count(*) AS runs, sum(event_id % 600)::bigint AS total_seconds, sum(user_id)::bigint AS total_rows, round(sum(event_id % 600) * 100.0::double / sum(user_id), 4) AS seconds_per_100 FROM events WHERE event_id % 10 <> 0 GROUP BY 1""")
def group_timing(spark, d):
    seconds = F.col("event_id") % 600
    end = F.when(F.col("event_id") % 10 != 0, F.timestamp_add("SECOND", seconds.cast("int"), F.col("ts").cast("timestamp")))
    return metadata.timings(table(spark, d, "events").withColumn("finished", end), "event_type", "ts", "finished", "user_id")


@query("SELECT (SELECT count(*) FROM orders) AS runs, (SELECT count(*) FROM customer) AS datasets, (SELECT round(avg(o_totalprice), 2) FROM orders) AS average_score")
def dashboard_counts(spark, d):
    o = table(spark, d, "orders").agg(F.count("*").alias("runs"), F.round(F.avg("o_totalprice"), 2).alias("average_score"), F.lit(1).alias("one"))
    c = table(spark, d, "customer").agg(F.count("*").alias("datasets"), F.lit(1).alias("one"))
    return o.join(c, "one").select("runs", "datasets", "average_score")


@query("SELECT o_orderkey, o_custkey, d AS placed FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS d FROM orders) ORDER BY d DESC NULLS LAST, o_orderkey DESC LIMIT 20")
def recent_n(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("placed"))
    return metadata.recent(o, "placed", 20, "o_orderkey")


@query("""WITH a AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at_ FROM orders), b AS (SELECT 'event' AS kind, event_id AS id, ts AS at_ FROM events), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT kind, id, at_ AS at FROM u ORDER BY at_ DESC, kind, id DESC LIMIT 20""".replace(" AS at FROM", ' AS "at" FROM'))
def activity_union_limit(spark, d):
    return metadata.activity([("order", table(spark, d, "orders"), "o_orderkey", "o_orderdate"), ("event", table(spark, d, "events"), "event_id", "ts")])


@query("SELECT event_id, event_type, json_extract_string(props, '$.' || k) AS prop FROM (SELECT *, json_keys(props)[1] AS k FROM events)")
def json_rule_extract(spark, d):
    key = F.element_at(F.json_object_keys("props"), 1)
    value = F.from_json("props", "map<string,string>")[key]
    return table(spark, d, "events").select("event_id", "event_type", value.alias("prop"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.filter(F.col("o_orderkey") % 4 == 0).withColumn("o_orderstatus", F.lit("F"))
    return metadata.upsert(o, changes, ["o_orderkey"])


@query("SELECT regexp_replace(m, '_group_\\d+$', '') AS model, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN event_type || '_group_' || (event_id % 5)::varchar ELSE event_type END AS m FROM events) GROUP BY 1")
def model_name_suffix(spark, d):
    from weftline.functions.exprs import strip_group

    name = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("_group_"), (F.col("event_id") % 5).cast("string"))).otherwise(F.col("event_type"))
    return table(spark, d, "events").select(strip_group(name).alias("model")).groupBy("model").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, e.user_id, c.c_name, n.n_name FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE e.event_type LIKE 'p%'")
def owner_join(spark, d):
    e, c, n = (table(spark, d, t) for t in ("events", "customer", "nation"))
    joined = e.filter(F.col("event_type").like("p%")).join(c, F.col("user_id") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("event_id", "user_id", "c_name", "n_name")


@query("""WITH g AS (SELECT p_name AS metric, round(avg(p_size) FILTER (p_partkey % 2 = 0), 4) AS b, round(avg(p_size) FILTER (p_partkey % 2 <> 0), 4) AS a FROM part GROUP BY 1), x AS (SELECT metric, a, round(a - b, 4) AS delta, CASE WHEN metric LIKE '%ring' THEN 27.0::double END AS goal FROM g WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT metric, CASE WHEN delta < 0 THEN 'regressed' ELSE 'below_target' END AS insight, CASE WHEN delta < 0 AND abs(delta) >= 10 THEN 'high' WHEN delta < 0 THEN 'medium' WHEN goal - a >= 15 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE delta < 0 OR coalesce(a < goal, false)""")
def feedback_insights(spark, d):
    """Part names play metrics, even and odd keys the values before and after."""
    from weftline.operators import rules

    part = table(spark, d, "part")
    side = lambda odd: part.filter(F.col("p_partkey") % 2 == odd).groupBy(F.col("p_name").alias("metric")).agg(F.round(F.avg("p_size"), 4).alias("value"))
    goals = {r["p_name"]: 27.0 for r in part.select("p_name").filter("p_name like '%ring'").distinct().collect()}
    deltas = rules.metric_delta(side(0), side(1), ()).filter("value_before is not null and value_after is not null")
    return metadata.insights(deltas, goals)
