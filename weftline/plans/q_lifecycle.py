"""Queries over whole steps: actions, frames, checks, answers, linked tables, evaluations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions import exprs, roles
from weftline.functions.storage import shared_folder
from weftline.operators import clean, compare, encode, generate, keys, marginals, ml, profile, repair, rules, shape, text
from weftline.plans import lifecycle, metadata
from weftline.plans.q_compare import halves
from weftline.plans.registry import SQL, query, table
from weftline.streaming import generation

@query("SELECT 'ID_' || row_number() OVER (ORDER BY s_name)::varchar AS s_suppkey, s_name, s_acctbal, s_acctbal + s_nationkey AS total FROM supplier")
def column_actions(spark, d):
    made = [{"name": "total", "operation": "add", "columns": ["s_acctbal", "s_nationkey"]}]
    actions = {"s_suppkey": "new_id", "s_nationkey": "delete", "s_name": "generalize"}
    return clean.apply_actions(table(spark, d, "supplier"), actions, ["s_name"], made)


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def model_frame(spark, d):
    return shape.model_columns(table(spark, d, "orders"), {"o_custkey": "remove", "o_orderstatus": "drop", "o_orderpriority": "text", "o_totalprice": "keep"})


@query("SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def training_columns(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return shape.training_frame(lines, ["l_orderkey"], ["l_partkey"], ["l_extendedprice"], [])


@query("SELECT c_custkey, c_nationkey::varchar AS c_nationkey FROM customer")
def few_valued_numbers(spark, d):
    return shape.few_valued_as_text(table(spark, d, "customer").select("c_custkey", "c_nationkey"), high=30)


@query("""SELECT * FROM (VALUES ('null o_totalprice'), ('infinite discount')) t(problem) UNION ALL SELECT (SELECT count(*) FROM orders)::varchar || ' rows, not 7'""")
def output_checks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 9 == 0, float("inf")).otherwise(0.5).alias("discount"))
    return spark.createDataFrame([(p,) for p in clean.output_problems(o, 7)], "problem string")


@query("""SELECT * FROM (VALUES ('columns differ'), ('p_size is not a number'), ('p_brand repeats')) t(problem)""")
def synthetic_checks(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    made = part.select("p_brand", "p_partkey", F.concat(F.lit("x"), "p_size").alias("p_size"))
    return spark.createDataFrame([(p,) for p in shape.synthetic_problems(made, part, part.count(), ["p_partkey", "p_brand"])], "problem string")


@query("""SELECT o_orderkey, o_orderdate, o_totalprice, items, quantity FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) LEFT JOIN (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) ON o_orderkey = l_orderkey""")
def runs_left_join_results(spark, d):
    lines = table(spark, d, "lineitem").filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"), F.sum("l_quantity").alias("quantity"))
    return metadata.runs_with_results(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), lines, "o_orderkey", "o_orderdate", 200)


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 8 = 0 THEN 'NONE' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def coalesce_update(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    changed = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 8 == 0, "NONE").alias("o_orderpriority"))
    return metadata.partial_update(o, changed, ["o_orderkey"])


@query("SELECT l_orderkey, l_partkey, l_linenumber, strftime(l_shipdate + to_days(greatest(l_linenumber - 3, 0)), '%Y-%m-%d') AS arrival FROM lineitem")
def add_duration(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", exprs.add_days("l_shipdate", F.col("l_linenumber") - 3).alias("arrival"))


@query("SELECT * FROM (VALUES ('order_date', 'ship_date', 'ship_date__diff_days')) t(start, target, days)")
def date_difference_rules(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("order_date"), F.date_add("o_orderdate", (F.col("o_orderkey") % 20).cast("int")).cast("timestamp").alias("ship_date"))
    found = rules.detect_derived(o, [], dates=["order_date", "ship_date"])
    return spark.createDataFrame([(r["start"], r["target"], r["days"]) for r in found], "start string, target string, days string")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(o_orderdate + to_days((o_orderkey % 20)::int), '%Y-%m-%d') AS ship_date FROM orders")
def rebuilt_end_dates(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("order_date"), day(F.date_add("o_orderdate", (F.col("o_orderkey") % 20).cast("int"))).alias("ship_date"))
    found = rules.detect_derived(o, [], dates=["order_date", "ship_date"])
    return rules.apply_derived(rules.with_spans(o, found), found)


@query("SELECT c_custkey AS id, 'Segment ' || c_mktsegment AS text FROM customer WHERE c_custkey % 6 <> 0")
def answers_by_number(spark, d):
    c = table(spark, d, "customer").withColumn("batch", F.floor(F.col("c_custkey") / 20))
    record = F.struct(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 == 0, "n/a").otherwise(F.concat(F.lit("Segment "), "c_mktsegment")).alias("text"))
    asked = c.groupBy("batch").agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.sort_array(F.collect_list(record)).alias("records"))), F.lit("\n```")).alias("answer"), F.sort_array(F.collect_list("c_custkey")).alias("ids"))
    return text.answers_by_id(asked, "answer", "ids")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A ' || p_name WHEN 1 THEN 'A ' || p_name ELSE NULL END AS cleaned FROM part")
def generated_text_cleaning(spark, d):
    name = F.concat(F.lit("A "), "p_name")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('"'), name, F.lit('" '))).when(F.col("p_partkey") % 5 == 1, name).when(F.col("p_partkey") % 5 == 2, "N/A").when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("Here is "), name)).otherwise('[{"id": 1')
    return table(spark, d, "part").select("p_partkey", text.clean_generated(raw).alias("cleaned"))


@query("SELECT s_suppkey, 'UL#D' AS signature, 'S-' || s_suppkey AS code, s_suppkey AS number FROM supplier")
def id_signatures(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", exprs.signature("s_name").alias("signature"), F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("code"), exprs.last_number("s_name").alias("number"))


@query("SELECT column_name, CASE WHEN column_type IN ('VARCHAR', 'TIMESTAMP', 'BOOLEAN', 'DATE') THEN 'categorical' ELSE 'numeric' END AS kind FROM (DESCRIBE SELECT * FROM lineitem)")
def column_kinds(spark, d):
    kinds = profile.column_kinds(table(spark, d, "lineitem"))
    return spark.createDataFrame([(c, "numeric") for c in kinds["numeric_columns"]] + [(c, "categorical") for c in kinds["categorical_columns"]], "column_name string, kind string")


COMPACT = ("p_brand", "p_type", "p_size")


def compact_sql() -> str:
    parts = []
    for c in COMPACT:
        v = f"{c}::varchar"
        top = f"(SELECT '{{' || string_agg('\"' || v || '\":' || n, ',' ORDER BY v) || '}}' FROM (SELECT {v} AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3))"
        some = f"(SELECT '[' || string_agg('\"' || v || '\"', ',' ORDER BY v) || ']' FROM (SELECT {v} AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3))"
        parts.append(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c})::double / count(*), 6) AS unique_ratio, 0.0::double AS null_ratio, round(avg(length({v})), 6) AS avg_length, {top} AS top_values, {some} AS sample_values FROM part")
    return " UNION ALL ".join(parts)


@query(compact_sql())
def compact_profile(spark, d):
    out = profile.full_profile(table(spark, d, "part").select(*COMPACT), top=3, samples=3)
    return out.select("column_name", "unique_count", F.round("unique_ratio", 6).alias("unique_ratio"), "null_ratio", F.round("avg_length", 6).alias("avg_length"), "top_values", "sample_values")


@query("SELECT metric, round(score, 2) AS score, threshold FROM (SELECT 'statistical' AS metric, least(100, 70 + count(*) % 3) AS score, 75.0::double AS threshold FROM orders UNION ALL SELECT 'correlation', 90, 70.0 FROM region LIMIT 2) WHERE score < threshold")
def weak_metric_rows(spark, d):
    n = table(spark, d, "orders").count()
    rows = [("statistical", float(min(100, 70 + n % 3))), ("correlation", 90.0)]
    return metadata.weak_metrics(spark.createDataFrame(rows, "metric string, score double"))


@query("""SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FILTER (o_orderkey % 10 = 0) FROM orders) AS missing, 'unit' AS added, 'o_orderpriority' AS removed, 1 AS kept, 1 AS dropped""")
def preprocessing_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"), "o_orderpriority")
    s = shape.preprocessing_summary(o, o.drop("o_orderpriority").withColumn("unit", F.lit(1)), {"o_orderpriority": "remove", "price": "keep"})
    row = (s["rows"], s["missing_filled"]["price"], ",".join(s["added"]), ",".join(s["removed"]), s["actions"]["keep"], s["actions"]["remove"])
    return spark.createDataFrame([row], "rows long, missing long, added string, removed string, kept int, dropped int")


@query("""WITH a AS (SELECT value, n, sum(n) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - n AS b FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)), e AS (SELECT value, n * 500 / sum(n) OVER ()::double AS x FROM a), f AS (SELECT value, floor(x) AS base, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, value) AS place, 500 - sum(floor(x)) OVER () AS rest FROM e),
g AS (SELECT value, unnest(range(1, (base + (place <= rest)::int)::bigint + 1)) AS copy FROM f) SELECT row_number() OVER (ORDER BY md5(value || '|' || copy || '|42'), value, copy) - 1 AS position, value FROM g""")
def stratified_sample(spark, d):
    return repair.stratified_values(table(spark, d, "orders"), "o_orderpriority", 500)


@query("""WITH w AS (SELECT c_custkey, md5(c_custkey::varchar || '|42') AS h, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 1 END AS w FROM customer), o AS (SELECT *, sum(w) OVER (ORDER BY h, c_custkey ROWS UNBOUNDED PRECEDING) AS t, sum(w) OVER () AS n FROM w), k AS (SELECT c_custkey, floor(t / n::double * 700 + 0.5) - floor((t / n::double * 700 - w / n::double * 700) + 0.5) AS times FROM o)
SELECT c_custkey, times::bigint AS times FROM k WHERE times > 0""")
def systematic_draws(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 3.0).otherwise(1.0).alias("w"))
    return repair.systematic(c, "w", 700, ["c_custkey"], own_begin=True).groupBy("c_custkey").agg(F.count("*").alias("times"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def head_trim(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ranked = clean.numbered(o.withColumn("_m", -F.col("o_totalprice")), ["_m", "o_orderkey"], "_n")
    return ranked.filter("_n <= 25").select("o_orderkey", "o_totalprice")


@query("SELECT column_name, method FROM (VALUES ('o_orderstatus', 'onehot'), ('o_orderpriority', 'onehot'), ('o_comment', 'skip_text'), ('o_clerk_id', 'skip_identifier'), ('o_flag', 'skip_constant')) t(column_name, method)")
def encoding_choice(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.rpad("o_orderpriority", 90, "x").alias("o_comment"), F.col("o_custkey").cast("string").alias("o_clerk_id"), F.lit("y").alias("o_flag"))
    return spark.createDataFrame(list(encode.choose(o).items()), "column_name string, method string")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_custkey, c_name, c_acctbal, " + ", ".join(f"(c_mktsegment = '{s}')::int AS \"segment_{s}\"" for s in SEGMENTS) + " FROM customer")
def prepared_table(spark, d):
    return encode.prepare(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_mktsegment").alias("segment")))


@query("""WITH o AS (SELECT o_orderkey::double AS order_key, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS total_cost, (o_custkey % 9 + 1)::double AS quantity, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS state FROM orders), m AS (SELECT median(total_cost) AS c, (SELECT state FROM o WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS s FROM o),
f AS (SELECT order_key, coalesce(total_cost, c) AS total_cost, quantity, coalesce(state, s) AS state FROM o, m) SELECT order_key, round(total_cost, 4) AS total_cost, quantity, round(total_cost / quantity, 6) AS cost_per_unit, (state = 'F')::int AS "state_F", (state = 'O')::int AS "state_O", (state = 'P')::int AS "state_P" FROM f""")
def preprocess_whole(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("total_cost"), (F.col("o_custkey") % 9 + 1).alias("quantity"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("state"))
    out = clean.preprocess(o)
    return out.withColumns({"total_cost": F.round("total_cost", 4), "cost_per_unit": F.round("cost_per_unit", 6)})


@query("""WITH v AS (SELECT l_orderkey::double AS key, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS price, CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS flag, l_quantity AS quantity FROM lineitem), m AS (SELECT median(price) AS p, (SELECT flag FROM v WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS f FROM v),
w AS (SELECT key, coalesce(price, p) AS price, coalesce(flag, f) AS flag, quantity FROM v, m) SELECT key, round(price, 4) AS price, quantity, (flag = 'A')::int AS "flag_A", (flag = 'N')::int AS "flag_N", (flag = 'R')::int AS "flag_R" FROM w""")
def preprocess_lines(spark, d):
    return clean.preprocess(gapped_lines(spark, d)).withColumn("price", F.round("price", 4))


def gapped_lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_orderkey") % 13 != 0, F.col("l_returnflag")).alias("flag"), F.col("l_quantity").alias("quantity"))


@query(SQL["preprocess_lines"])
def preprocess_lines_written(spark, d):
    """The same table, checked by the job that writes it."""
    path = f"{shared_folder(spark)}/preprocessed-{uuid.uuid4().hex}"
    clean.preprocess_to(gapped_lines(spark, d), path)
    return spark.read.parquet(path).withColumn("price", F.round("price", 4))


def outlier_sql(columns) -> str:
    parts = []
    for c in columns:
        parts.append(f"SELECT '{c}' AS column_name, (SELECT count(*) FROM v, (SELECT quantile_cont({c}, 0.25) AS lo, quantile_cont({c}, 0.75) AS hi FROM v) WHERE {c} < lo - 1.5 * (hi - lo) OR {c} > hi + 1.5 * (hi - lo)) AS iqr, (SELECT count(*) FROM v, (SELECT avg({c}) AS m, stddev_samp({c}) AS sd FROM v) WHERE abs(({c} - m) / sd) > 3) AS zscore")
    return "WITH v AS (SELECT CASE WHEN event_id % 97 = 0 THEN value * 60 ELSE value END AS value, user_id::double AS user_id FROM events) " + " UNION ALL ".join(parts)


@query(outlier_sql(("value", "user_id")))
def outlier_counts(spark, d):
    return clean.outliers(table(spark, d, "events").select(F.when(F.col("event_id") % 97 == 0, F.col("value") * 60).otherwise(F.col("value")).alias("value"), "user_id"))


@query("SELECT * FROM (VALUES ('order_id', 'identifiers'), ('supplier_code', 'identifiers'), ('order_date', 'dates'), ('qty_on_hand', 'inventory_levels'), ('quantity', 'quantities'), ('unit_price', 'prices'), ('order_status', 'statuses'), ('priority', 'categories')) t(column_name, concept)")
def business_roles(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("supplier_code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), (F.col("o_custkey") % 90).alias("qty_on_hand"), (F.col("o_custkey") % 9).alias("quantity"), (F.col("o_totalprice") / 100).alias("unit_price"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("priority"))
    found = roles.business_roles(o)
    return spark.createDataFrame([(c, k) for k, v in found.items() for c in v], "column_name string, concept string")


@query("SELECT 'order_id' AS column_name WHERE (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders) UNION ALL SELECT 'cust_id' WHERE (SELECT count(DISTINCT o_custkey) = count(*) FROM orders)")
def unique_id_columns(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"), F.col("o_totalprice").alias("price_key"))
    return spark.createDataFrame([(c,) for c in keys.id_columns(o)], "column_name string")


@query("SELECT * FROM (VALUES ('total', 'multiply', 'quantity', 'price')) t(target, operation, left_column, right_column)")
def analysed_table(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.round(F.col("l_extendedprice") / 100, 2).alias("price"), "l_returnflag").withColumn("total", F.col("quantity") * F.col("price"))
    found = shape.analyse_table(lines)["derived"]
    return spark.createDataFrame([(r["target"], r["operation"], *r["operands"]) for r in found], "target string, operation string, left_column string, right_column string")


@query("SELECT 'flag' AS column_name")
def divergent_groups(spark, d):
    lines = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("flag"), "l_linestatus", (F.col("l_quantity") + F.when(F.col("l_linenumber") % 2 == 0, 40).otherwise(0)).alias("quantity"))
    found = shape.divergent_column(lines, ["l_linestatus", "flag"], ["quantity"])
    return spark.createDataFrame([(found,)], "column_name string")


@query("SELECT * FROM (VALUES (1, 'target'), (2, 'order_status'), (3, 'price')) t(place, column_name)")
def target_ranking(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).cast("string").alias("target"), F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").alias("price"), F.lit("one").alias("constant"))
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(ml.rank_targets(o, ["o_orderkey"]))], "place int, column_name string")


@query("SELECT check_name, 0::bigint AS bad_rows, true AS passed FROM (VALUES ('customer.c_custkey unique'), ('orders.o_orderkey unique'), ('orders.o_custkey -> customer.c_custkey')) t(check_name)")
def linked_checks(spark, d):
    tables = {"customer": table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")}
    relations, primary = [("customer", "c_custkey", "orders", "o_custkey")], {"customer": "c_custkey", "orders": "o_orderkey"}
    return generate.linked_report(generate.linked(tables, relations, primary, {"customer": 200, "orders": 600}), relations, primary)


@query("SELECT 400::bigint AS rows, 0::bigint AS broken, 400::bigint AS places")
def generated_rows_keep_rules(spark, d):
    part = table(spark, d, "part").select("p_size", "p_retailprice", "p_brand")
    made = generate.generate_rows(generate.GaussianCopula().fit(part), spark, 400, part, [{"rule_type": "range", "column": "p_size", "min": 5}], actions={"p_brand": "new_id"})
    return made.agg(F.count("*").alias("rows"), F.count_if(F.col("p_size") < 5).alias("broken"), F.count_distinct("p_brand").alias("places"))


@query("SELECT 'tvd' AS measure, true AS closer UNION ALL SELECT 'ks', true UNION ALL SELECT 'rows', true")
def matched_categories(spark, d):
    real, synthetic = halves(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    off = synthetic.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "BUILDING").otherwise(F.col("c_mktsegment"))).withColumn("c_acctbal", F.col("c_acctbal") + 2000)
    out = repair.match_marginals(real, repair.match_categories(real, off, ["c_mktsegment"], ["c_custkey"]), ["c_acctbal"], ["c_custkey"])
    gaps = [(compare.tvd(real, x, ["c_mktsegment"]).first()["tvd"], compare.ks(real, x, ["c_acctbal"]).first()["ks_statistic"]) for x in (off, out)]
    rows = [("tvd", gaps[1][0] < gaps[0][0]), ("ks", gaps[1][1] < gaps[0][1]), ("rows", out.count() == off.count())]
    return spark.createDataFrame(rows, "measure string, closer boolean")


@query("""WITH u AS (SELECT 'l_quantity' AS column_name, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
m AS (SELECT column_name, avg(x) AS m, var_pop(x) AS v, min(x) AS l, max(x) AS h FROM u GROUP BY column_name), b AS (SELECT *, (m - l) / (h - l) AS bm, (m - l) / (h - l) * (1 - (m - l) / (h - l)) / (v / (h - l) ^ 2) - 1 AS c FROM m)
SELECT column_name, 'norm' AS distribution, round(m, 6) AS first, round(sqrt(v), 6) AS second, l AS low, h AS high FROM m UNION ALL SELECT column_name, 'uniform', round(l, 6), round(h - l, 6), l, h FROM m
UNION ALL SELECT column_name, 'gamma', round((m - l) ^ 2 / v, 6), round(v / (m - l), 6), l, h FROM m UNION ALL SELECT column_name, 'beta', round(bm * c, 6), round((1 - bm) * c, 6), l, h FROM b WHERE c > 0""")
def fitted_marginals(spark, d):
    found = marginals.fitted(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ("gaussian", "uniform", "gamma", "beta"))
    return found.select("column_name", "distribution", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), "low", "high")


@query("SELECT 2 * count(*) AS rows, count(*) // 2 AS rows_of_first_run, 0::bigint AS rows_unlike_one_run FROM part")
def generation_stream(spark, d):
    """A stream that makes half of a table's number of rows, stops, goes on to twice the number, and is held against rows made at once."""
    part, path = table(spark, d, "part").select("p_size", "p_retailprice", "p_brand"), f"{shared_folder(spark)}/generation-{uuid.uuid4().hex}"
    n, model = part.count(), generate.GaussianCopula().fit(part)
    half = generation.generate_stream(model, spark, n // 2, path, batch=max(1, n // 5)).count()
    whole = generation.generate_stream(model, spark, 2 * n, path, batch=max(1, n // 3))
    unlike = whole.exceptAll(model.generate(spark, 2 * n)).count()
    return whole.agg(F.count("*").alias("rows")).select("rows", F.lit(half).cast("long").alias("rows_of_first_run"), F.lit(unlike).cast("long").alias("rows_unlike_one_run"))


@query()
def evaluate_tables(spark, d):
    real, synthetic = halves(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), "o_orderkey")
    return lifecycle.evaluate(real, synthetic, "o_orderkey")


@query("SELECT 'price' AS column_name, 'numerical' AS role UNION ALL SELECT 'priority', 'categorical' UNION ALL SELECT 'order_id', 'identifier' UNION ALL SELECT 'note', 'free_form_text' UNION ALL SELECT 'placed_date', 'datetime_not_supported'")
def comparable_columns(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("order_id"), F.concat_ws(" ", F.lit("placed by"), "o_custkey").alias("note"), F.col("o_orderdate").alias("placed_date"))
    use, other = compare.eligible(o)
    return spark.createDataFrame(list({**use, **other}.items()), "column_name string, role string")
