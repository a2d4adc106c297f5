"""Repair, sampling, generation and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import repair
from weftline.plans.q_compare import halves
from weftline.plans.registry import query, table


@query("""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rk, count(*) OVER () AS n FROM orders WHERE o_orderkey % 2 <> 0), r AS (SELECT o_totalprice * 1.1 AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS m FROM orders WHERE o_orderkey % 2 = 0),
p AS (SELECT o_orderkey, (rk - 0.5::double) / n * ((SELECT max(m) FROM r) - 1) AS pos FROM s)
SELECT o_orderkey, round(a.v + (pos - floor(pos)) * (coalesce(b.v, a.v) - a.v), 6) AS o_totalprice FROM p JOIN r a ON a.i = floor(pos)::bigint LEFT JOIN r b ON b.i = floor(pos)::bigint + 1""")
def marginal_match(spark, d):
    real, synthetic = halves(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    out = repair.quantile_map(real.withColumn("o_totalprice", F.col("o_totalprice") * F.lit(1.1)), synthetic, "o_totalprice", ["o_orderkey"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders), s AS (SELECT o_orderkey, row_number() OVER (ORDER BY p, o_orderkey) AS rk, count(*) OVER () AS n FROM o WHERE o_orderkey % 2 <> 0 AND p IS NOT NULL), r AS (SELECT p * 1.1 AS v, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS m FROM o WHERE o_orderkey % 2 = 0 AND p IS NOT NULL),
q AS (SELECT o_orderkey, (rk - 0.5::double) / n * ((SELECT max(m) FROM r) - 1) AS pos FROM s)
SELECT o_orderkey, round(a.v + (pos - floor(pos)) * (coalesce(b.v, a.v) - a.v), 6) AS o_totalprice FROM q JOIN r a ON a.i = floor(pos)::bigint LEFT JOIN r b ON b.i = floor(pos)::bigint + 1 UNION ALL SELECT o_orderkey, NULL FROM o WHERE o_orderkey % 2 <> 0 AND p IS NULL""")
def marginal_match_nulls(spark, d):
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice")
    real, synthetic = halves(table(spark, d, "orders").select("o_orderkey", price), "o_orderkey")
    out = repair.quantile_map(real.withColumn("o_totalprice", F.col("o_totalprice") * F.lit(1.1)), synthetic, "o_totalprice", ["o_orderkey"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("""WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT value, n::double / sum(n) OVER () AS share, n * 1003 / sum(n) OVER ()::double AS x FROM c), f AS (SELECT *, floor(x) AS b, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, value) AS place FROM e)
SELECT value, round(share, 6) AS share, (b + (place <= 1003 - sum(b) OVER ())::int)::bigint AS allocated FROM f""")
def stratified_allocation(spark, d):
    return repair.allocate(table(spark, d, "orders"), "o_orderpriority", 1003)


@query("""WITH g AS (SELECT c_mktsegment AS value, count(*) FILTER (c_custkey % 2 = 0) AS r, count(*) FILTER (c_custkey % 2 <> 0) AS s FROM customer GROUP BY 1), p AS (SELECT value, r::double / sum(r) OVER () AS p, s::double / sum(s) OVER () AS q FROM g)
SELECT value, round(p, 6) AS p_real, round(q, 6) AS p_synthetic, round(greatest(p, 0.01::double) / greatest(q, 0.001::double), 6) AS weight FROM p""")
def resample_weights(spark, d):
    real, synthetic = halves(table(spark, d, "customer"), "c_custkey")
    return repair.class_weights(real, synthetic, "c_mktsegment")


@query("""WITH g AS (SELECT c_mktsegment AS value, count(*) FILTER (c_custkey % 2 = 0) AS r, count(*) FILTER (c_custkey % 2 <> 0) AS s FROM customer GROUP BY 1), p AS (SELECT value, r::double / sum(r) OVER () AS p, s::double / sum(s) OVER () AS q FROM g),
w AS (SELECT c.*, md5(c_custkey::varchar || '|42') AS h, round(greatest(p, 0.01::double) / greatest(q, 0.001::double), 6) AS w FROM customer c JOIN p ON c_mktsegment = value WHERE c_custkey % 2 <> 0),
o AS (SELECT *, sum(w) OVER (ORDER BY h, c_custkey ROWS UNBOUNDED PRECEDING) AS t, sum(w) OVER () AS n FROM w), k AS (SELECT *, floor(t / n * 500 + 0.5) - floor((t - w) / n * 500 + 0.5) AS times FROM o)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT *, unnest(range(times::bigint)) FROM k WHERE times > 0)""")
def weighted_resample(spark, d):
    real, synthetic = halves(table(spark, d, "customer"), "c_custkey")
    weights = repair.class_weights(real, synthetic, "c_mktsegment")
    return repair.weighted_resample(synthetic, weights, "c_mktsegment", 500, ["c_custkey"])


@query("""WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
g AS (SELECT c_mktsegment AS value, count(*) FILTER (c_custkey % 2 = 0) AS r, count(*) FILTER (c_custkey % 2 <> 0) AS s FROM c WHERE c_mktsegment IS NOT NULL GROUP BY 1), p AS (SELECT value, r::double / sum(r) OVER () AS p, s::double / sum(s) OVER () AS q FROM g),
w AS (SELECT c.*, md5(c_custkey::varchar || '|42') AS h, CASE WHEN value IS NULL THEN 1.0::double ELSE round(greatest(p, 0.01::double) / greatest(q, 0.001::double), 6) END AS w FROM c LEFT JOIN p ON c_mktsegment = value WHERE c_custkey % 2 <> 0),
o AS (SELECT *, sum(w) OVER (ORDER BY h, c_custkey ROWS UNBOUNDED PRECEDING) AS t, sum(w) OVER () AS n FROM w), k AS (SELECT *, floor(t / n * 500 + 0.5) - floor((t - w) / n * 500 + 0.5) AS times FROM o)
SELECT c_custkey, c_acctbal, c_mktsegment FROM (SELECT *, unnest(range(times::bigint)) FROM k WHERE times > 0)""")
def weighted_resample_nulls(spark, d):
    part = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    real, synthetic = halves(part, "c_custkey")
    return repair.weighted_resample(synthetic, repair.class_weights(real, synthetic, "c_mktsegment"), "c_mktsegment", 500, ["c_custkey"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::varchar || '|42'), o_orderkey) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM orders")
def train_test_split_md5(spark, d):
    return repair.train_test_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey::varchar || '|42'), c_custkey LIMIT 100")
def random_sample_md5(spark, d):
    return repair.random_sample(table(spark, d, "customer").select("c_custkey", "c_name"), 100, ["c_custkey"])


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT (SELECT (count(*) / 2)::bigint FROM supplier))")
def bootstrap_fill(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    n = s.count()
    return repair.fill_up(s, n + int(n / 2 + 0.5), ["s_suppkey"])


CANDIDATES = """SELECT p_brand AS candidate, 40 + avg(p_size) AS s, (count(*) % 100)::double AS co, CASE WHEN min(p_partkey) % 2 = 0 THEN 50.0::double + max(p_size) END AS m, 90.0::double AS p, CASE WHEN max(p_partkey) % 3 = 0 THEN 98.0::double ELSE 100.0::double END AS k, 95.0::double AS v, 100.0::double - min(p_size) AS u, CASE WHEN max(p_size) < 50 THEN 97.0::double END AS t, CASE WHEN max(p_partkey) % 5 = 0 THEN 0.5::double ELSE 0.0::double END AS e FROM part GROUP BY 1"""
SCORED = f"""WITH c AS ({CANDIDATES}) SELECT candidate, round((s * 0.22::double + co * 0.16::double + coalesce(m, 0) * 0.18::double + p * 0.14::double + k * 0.1::double + v * 0.1::double + u * 0.05::double + coalesce(t, 0) * 0.05::double) / (0.77::double + CASE WHEN m IS NULL THEN 0 ELSE 0.18::double END + CASE WHEN t IS NULL THEN 0 ELSE 0.05::double END), 4) AS score, k >= 99.999 AND e <= 0.01 AND u > 0 AS is_valid FROM c"""


def candidate_rows(spark, d):
    """The brands of parts play candidates."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("candidate")).agg(
        (40 + F.avg(size)).alias("statistical"), (F.count("*") % 100).cast("double").alias("correlation"), F.when(F.min(key) % 2 == 0, 50.0 + F.max(size)).alias("ml_utility"), F.lit(90.0).alias("privacy"),
        F.when(F.max(key) % 3 == 0, 98.0).otherwise(100.0).alias("completeness"), F.lit(95.0).alias("domain_validity"), (100.0 - F.min(size)).alias("uniqueness"), F.when(F.max(size) < 50, 97.0).alias("chronology"), F.when(F.max(key) % 5 == 0, 0.5).otherwise(0.0).alias("exact_match_rate"),
    )


@query(SCORED)
def candidate_score(spark, d):
    return repair.candidate_scores(candidate_rows(spark, d))


@query(f"SELECT candidate, score, is_valid FROM ({SCORED}) WHERE is_valid ORDER BY score DESC, candidate LIMIT 1")
def best_candidate(spark, d):
    return repair.best_candidate(repair.candidate_scores(candidate_rows(spark, d)))


@query()
def copula_sample(spark, d):
    from weftline.operators import generate

    o = table(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    return generate.GaussianCopula().fit(o).generate(spark, 1000)


@query("""SELECT 'rows' AS fact, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'below', count(*) FILTER (o_totalprice < (SELECT min(o_totalprice) FROM orders)) FROM orders
UNION ALL SELECT 'above', count(*) FILTER (o_totalprice > (SELECT max(o_totalprice) FROM orders)) FROM orders UNION ALL SELECT 'unknown values', count(*) FILTER (o_orderstatus NOT IN (SELECT o_orderstatus FROM orders)) FROM orders UNION ALL SELECT 'mean off by tenths of the deviation', 0""")
def copula_sample_facts(spark, d):
    """What must hold of rows that are drawn, whatever the draws: their number, all of the few values, no others, the range, the mean."""
    from weftline.operators import generate

    o = table(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    n = o.count()
    made = generate.GaussianCopula().fit(o).generate(spark, n)
    real = o.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.avg("o_totalprice").alias("mean"), F.stddev("o_totalprice").alias("sd")).first()
    known = [r["o_orderstatus"] for r in o.select("o_orderstatus").distinct().collect()]
    p = F.col("o_totalprice")
    facts = {"rows": F.count("*"), "o_orderstatus": F.count_distinct("o_orderstatus"), "o_orderpriority": F.count_distinct("o_orderpriority"), "below": F.count_if(p < real["low"]), "above": F.count_if(p > real["high"]), "unknown values": F.count_if(~F.col("o_orderstatus").isin(known)), "mean off by tenths of the deviation": F.floor(F.abs(F.avg(p) - real["mean"]) / real["sd"] * 10)}
    row = made.agg(*(v.cast("long").alias(k) for k, v in facts.items()))
    return row.unpivot([], list(facts), "fact", "n")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice * 1.5 AS p FROM orders WHERE o_orderkey % 2 <> 0), r AS (SELECT o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0)
SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (o_orderkey % 5 = 0) AS without_price, 0::bigint AS beyond_real_range, true AS same_order FROM s""")
def improved_facts(spark, d):
    """A table with missing prices after its marginals are matched: every row and key is there, prices lie in the real range and keep their order."""
    real, synthetic = halves(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")
    shifted = synthetic.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") * 1.5))
    out = repair.match_marginals(real, shifted, ["o_totalprice"], ["o_orderkey"])
    low, high = real.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    both = out.join(shifted.select("o_orderkey", F.col("o_totalprice").alias("before")), "o_orderkey")
    # in a kept order, the largest mapped value below a tenth of the old ones is below the smallest above it
    cuts = shifted.approxQuantile("o_totalprice", [i / 10 for i in range(1, 10)], 0.001)
    p, b = F.col("o_totalprice"), F.col("before")
    kept = [F.coalesce(F.max(F.when(b < c, p)) <= F.min(F.when(b >= c, p)), F.lit(True)) for c in cuts]
    whole = kept[0]
    for k in kept[1:]:
        whole = whole & k
    return both.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys"), F.count_if(p.isNull()).alias("without_price"), F.count_if((p < low) | (p > high)).alias("beyond_real_range"), whole.alias("same_order"))


@query("""SELECT 'customer' AS table_name, count(*) // 2 AS rows, count(*) // 2 AS keys, 0::bigint AS orphans, count(DISTINCT c_mktsegment) AS labels FROM customer UNION ALL SELECT 'orders', count(*) // 2, count(*) // 2, 0, count(DISTINCT o_orderstatus) FROM orders""")
def linked_facts(spark, d):
    """Linked tables of half the originals' sizes: rows, keys, foreign keys without a parent, and the label values."""
    from weftline.operators import generate

    tables = {"customer": table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")}
    sizes = {k: v.count() // 2 for k, v in tables.items()}
    made = generate.linked(tables, [("customer", "c_custkey", "orders", "o_custkey")], {"customer": "c_custkey", "orders": "o_orderkey"}, sizes)
    lost = made["orders"].join(made["customer"].select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").count()
    facts = lambda name, key, label, orphans: made[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.lit(orphans).cast("long").alias("orphans"), F.count_distinct(label).alias("labels"))
    return facts("customer", "c_custkey", "c_mktsegment", 0).unionByName(facts("orders", "o_orderkey", "o_orderstatus", lost))


@query()
def linked_generate(spark, d):
    from weftline.operators import generate

    tables = {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")}
    made = generate.linked(tables, [("customer", "c_custkey", "orders", "o_custkey")], {"customer": "c_custkey", "orders": "o_orderkey"}, 300)
    return made["orders"]


@query()
def ml_utility(spark, d):
    from weftline.operators import ml

    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size")).alias("margin"))
    real, synthetic = halves(part, "p_partkey")
    return ml.utility(real, synthetic, "margin", ["p_partkey"])


@query()
def improve_quality(spark, d):
    real, synthetic = halves(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")
    shifted = synthetic.withColumn("o_totalprice", F.col("o_totalprice") * 1.5)
    return repair.enhance(real, shifted, ["o_totalprice"], ["o_orderpriority"], ["o_orderkey"])


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_counts(spark, d):
    from weftline.streaming import batches

    out = batches.windowed_counts(spark, d)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id::varchar AS run, max(ts) AS beat FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def stale_watch(spark, d):
    """Timers of a stream against what a table says at the end."""
    from weftline.streaming import heartbeats

    return heartbeats.stale_events(spark, d).select("run", F.col("beat").cast("timestamp_ntz").alias("beat"))
