"""Key and id queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import keys
from weftline.plans.registry import query, table


def broken_orders(spark, d):
    key = F.when(F.col("o_custkey") % 7 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    return table(spark, d, "orders").withColumn("o_custkey", key)


@query("""SELECT 'orders' AS child, 'o_custkey' AS fk, 'customer' AS parent, 'c_custkey' AS pk, count(*) AS total_rows, count(*) FILTER (o_custkey % 7 <> 0) AS valid_rows, round(100.0::double * count(*) FILTER (o_custkey % 7 <> 0) / count(*), 4) AS score FROM orders
UNION ALL SELECT 'lineitem', 'l_partkey', 'part', 'p_partkey', count(*), count(*), 100.0::double FROM lineitem""")
def fk_integrity(spark, d):
    t = lambda n: table(spark, d, n)
    return keys.integrity([("orders", broken_orders(spark, d), "o_custkey", "customer", t("customer"), "c_custkey"), ("lineitem", t("lineitem"), "l_partkey", "part", t("part"), "p_partkey")])


@query("SELECT o_custkey + 1000000 AS key, count(*) AS rows FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1")
def fk_orphans_distinct(spark, d):
    return keys.orphan_keys(broken_orders(spark, d), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("SELECT count(*) AS total_rows, count(*) FILTER (o_custkey % 7 = 0 OR o_orderkey % 9 = 0) AS orphan_rows FROM orders")
def fk_null_is_orphan(spark, d):
    o = broken_orders(spark, d).withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")))
    return keys.foreign_key_rows(o, "o_custkey", table(spark, d, "customer"), "c_custkey")


PKS = (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("lineitem", "l_orderkey"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS total_rows, count(DISTINCT {k}) AS distinct_keys, count(*) - count({k}) AS null_keys, count(*) = count(DISTINCT {k}) AS is_unique FROM {t}" for t, k in PKS))
def pk_uniqueness(spark, d):
    parts = [keys.key_report(table(spark, d, t), k).select(F.lit(t).alias("table_name"), "*") for t, k in PKS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Customer ' || CASE WHEN length(c_custkey::varchar) >= 4 THEN c_custkey::varchar ELSE lpad(c_custkey::varchar, 4, '0') END ELSE c_name END AS name FROM customer")
def key_function_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("k"), "c_name")
    known = c.filter(F.col("c_custkey") % 3 != 0).withColumnRenamed("c_name", "name")
    return keys.apply_key_function(c.drop("c_name").withColumn("name", F.lit(None).cast("string")), "k", "name", known, "Customer ", 4).select("c_custkey", "name")


@query("SELECT round(avg((regexp_extract(c_name, '(\\d+)\\D*$', 1)::bigint = c_custkey)::int), 6) AS agreement, avg((regexp_extract(c_name, '(\\d+)\\D*$', 1)::bigint = c_custkey)::int) >= 0.95 AS is_key_function FROM customer")
def key_function_test(spark, d):
    return keys.key_function(table(spark, d, "customer"), "c_custkey", "c_name")


@query("""WITH n AS (SELECT c_custkey AS old_key, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), f AS (SELECT c_custkey + 5000000 AS new_key, row_number() OVER (ORDER BY c_custkey) - 1 AS j, count(*) OVER () AS m FROM customer WHERE c_custkey % 2 = 0),
k AS (SELECT old_key, new_key FROM n JOIN f ON i % m = j) SELECT o_orderkey, new_key AS o_custkey FROM orders JOIN k ON o_custkey = old_key""")
def parent_key_remap(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    final = c.filter(F.col("c_custkey") % 2 == 0).select((F.col("c_custkey") + 5_000_000).alias("c_custkey"))
    mapping = keys.remap(c, final, "c_custkey", "c_custkey", "c_custkey")
    return keys.rewrite_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", mapping)


@query("SELECT s_suppkey, 'SUP-' || lpad((1000 + row_number() OVER (ORDER BY s_suppkey))::varchar, 5, '0') AS code FROM supplier")
def id_counter_continues(spark, d):
    pattern = keys.id_pattern([f"SUP-{i:05d}" for i in range(901, 1001)])
    return keys.make_ids(table(spark, d, "supplier").select("s_suppkey"), "code", ["s_suppkey"], pattern)


@query("SELECT s_suppkey, s_name, md5('Supplier') = md5('Supplier') AS unique_ids FROM supplier")
def id_template_unique(spark, d):
    pattern = keys.id_pattern(["A9X-4F2", "B1K-7Q0", "Z3M-2T8", "Q5R-9W1", "C7P-0D4"])
    made = keys.make_ids(table(spark, d, "supplier").select("s_suppkey", "s_name"), "code", ["s_suppkey"], pattern)
    taken = made.groupBy("code").agg(F.count("*").alias("n"))
    ok = F.col("code").rlike(r"^[A-Z]\d[A-Z]-\d[A-Z]\d$") & (F.col("n") == 1)
    return made.join(taken, "code").select("s_suppkey", "s_name", ok.alias("unique_ids"))
