"""Cleaning and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import clean, encode
from weftline.plans.registry import query, table


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM v), v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS o_totalprice FROM orders)
SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM v, q WHERE o_totalprice < lo - 1.5 * (hi - lo) OR o_totalprice > hi + 1.5 * (hi - lo)""".replace("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM v), v AS", "WITH v AS").replace("FROM orders)\n", "FROM orders), q AS (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM v)\n"))
def outliers_iqr(spark, d):
    price = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice"))
    marked = clean.iqr_flags(table(spark, d, "orders").select("o_orderkey", price.alias("o_totalprice")), ["o_totalprice"])
    return marked.filter("o_totalprice_outlier").select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 400 = 0 THEN value * 40 ELSE value END AS value FROM events), s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM v)
SELECT event_id FROM v, s WHERE abs((value - m) / sd) > 3""")
def outliers_zscore(spark, d):
    value = F.when(F.col("event_id") % 400 == 0, F.col("value") * 40).otherwise(F.col("value"))
    return clean.zscore_flags(table(spark, d, "events").select("event_id", value.alias("value")), ["value"]).filter("value_outlier").select("event_id")


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS prio, CASE WHEN o_orderkey % 8 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS order_date FROM orders),
f AS (SELECT median(price) AS p, (SELECT prio FROM o WHERE trim(prio) <> '' GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1) AS m, strftime(make_timestamp((median(epoch(strptime(order_date, '%Y-%m-%d')))::bigint) * 1000000), '%Y-%m-%d') AS dt FROM o)
SELECT k::double AS order_key, round(coalesce(price, p), 4) AS price, CASE WHEN trim(prio) = '' THEN m ELSE prio END AS prio, coalesce(order_date, dt) AS order_date FROM o, f""")
def impute_median_mode_date(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("order_key"), F.when(k % 10 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("prio"),
        F.when(k % 8 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
    )
    return clean.impute(o).withColumn("price", F.round("price", 4))


@query("SELECT p_partkey::double AS p_partkey, 'unknown' AS amount, 'unknown' AS notes FROM part")
def impute_all_null_unknown(spark, d):
    return clean.impute(table(spark, d, "part").select("p_partkey", F.lit(None).cast("double").alias("amount"), F.lit("  ").alias("notes")))


@query("SELECT o_orderkey, o_orderdate, l_shipdate, floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0)::bigint AS lead_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def derive_lead_time(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return clean.lead_time(joined.select("o_orderkey", "o_orderdate", "l_shipdate"), "o_orderdate", "l_shipdate")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice / l_quantity END, 8) AS cost_per_unit FROM lineitem")
def derive_cost_per_unit(spark, d):
    q = F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(F.col("l_quantity"))
    out = clean.cost_per_unit(table(spark, d, "lineitem").withColumn("q", q), "l_extendedprice", "q")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("cost_per_unit", 8).alias("cost_per_unit"))


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::int AS \"segment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def encode_onehot(spark, d):
    return encode.one_hot(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment").drop("segment")


@query("WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, " + ", ".join(f"((code >> {b}) & 1)::int AS p_brand_bin_{b}" for b in range(5)) + " FROM part JOIN c USING (p_brand)")
def encode_binary(spark, d):
    return encode.binary(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").drop("p_brand")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_type) AS p_type_count, round(count(*) OVER (PARTITION BY p_type)::double / count(*) OVER (), 6) AS p_type_frequency FROM part")
def encode_frequency(spark, d):
    out = encode.frequency(table(spark, d, "part").select("p_partkey", "p_type"), "p_type").drop("p_type")
    return out.withColumn("p_type_frequency", F.round("p_type_frequency", 6))


@query("SELECT p_partkey, " + ", ".join(f"((('0x' || substr(md5(p_brand), 1, 8))::bigint % 8) = {i})::int AS p_brand_hash_{i}" for i in range(8)) + " FROM part")
def encode_hash_md5(spark, d):
    return encode.hashed(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 8).drop("p_brand")


@query("""WITH v AS (SELECT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), g AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT column_name, n, count(*) AS same FROM g GROUP BY ALL),
k AS (SELECT column_name, sum(same)::double AS k, coalesce(sum(same) FILTER (same > 1), 0)::double AS shared FROM s GROUP BY 1),
e AS (SELECT column_name, k, greatest(1.0::double, ceil(log2(greatest(2.0::double, k)))) AS bits, least(1.0::double, shared / k) AS loss, least(1.0::double, least(1.0::double, k * (k - 1) / 32.0::double) / k) AS clash FROM k)
SELECT column_name, 'onehot' AS method, round(0.05::double + 0.4::double * least(1.0::double, k / 30.0::double), 4) AS score, k AS output_dimensions FROM e UNION ALL SELECT column_name, 'binary', round(0.18::double + 0.04::double * least(1.0::double, bits / 30.0::double), 4), bits FROM e
UNION ALL SELECT column_name, 'frequency', round(0.18::double + 0.35::double * loss, 4), 1.0::double FROM e UNION ALL SELECT column_name, 'count', round(0.2::double + 0.35::double * loss, 4), 1.0::double FROM e
UNION ALL SELECT column_name, 'hashing', round(0.22::double + 0.3::double * clash + 0.03::double * least(1.0::double, 16.0::double / 30.0::double), 4), 16.0::double FROM e""")
def encode_cost_scores(spark, d):
    return encode.scores(table(spark, d, "part"), ["p_brand", "p_type"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS d_add, round(l_extendedprice - l_discount - l_tax, 6) AS d_sub, round(l_quantity * l_extendedprice * l_discount, 6) AS d_mul, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END, 4) AS d_div FROM lineitem""")
def derived_fold(spark, d):
    specs = [("d_add", "add", ["l_quantity", "l_discount", "l_tax"]), ("d_sub", "subtract", ["l_extendedprice", "l_discount", "l_tax"]), ("d_mul", "multiply", ["l_quantity", "l_extendedprice", "l_discount"]), ("d_div", "divide", ["l_extendedprice", "l_discount"])]
    out = clean.derived(table(spark, d, "lineitem"), [dict(zip(("name", "operation", "columns"), s)) for s in specs])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *(F.round(s[0], 4 if s[0] == "d_div" else 6).alias(s[0]) for s in specs))


@query("SELECT s_suppkey, s_name, 'supplier_' || lpad(row_number() OVER (ORDER BY s_suppkey)::varchar, 6, '0') AS supplier FROM supplier")
def new_id_counter(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("x").alias("supplier"))
    return clean.new_ids(s, "supplier", ["s_suppkey"])


@query("SELECT o_orderkey, month(o_orderdate) AS m, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS m_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS m_cos, round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS dow_cos, epoch(o_orderdate)::bigint AS ts FROM orders")
def cyclical_dates(spark, d):
    from weftline.operators.repair import cyclical

    out = cyclical(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return out.select("o_orderkey", F.month("o_orderdate").cast("long").alias("m"), *(F.round(f"o_orderdate__{c}", 6).alias(c) for c in ("m_sin", "m_cos", "dow_sin", "dow_cos")), F.col("o_orderdate__ts").alias("ts"))


@query()
def preprocess_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "o_orderpriority", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("total_cost"), (F.col("o_custkey") % 9).alias("quantity"))
    return clean.preprocess(o)
