"""Validation and rule-discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import rules
from weftline.plans.registry import query, table


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def rule_non_negative(spark, d):
    return table(spark, d, "customer").filter(rules.violation({"rule_type": "non_negative", "column": "c_acctbal"})).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def rule_not_null(spark, d):
    o = table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    return o.filter(rules.violation({"rule_type": "not_null", "column": "price"})).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 40")
def rule_range(spark, d):
    return table(spark, d, "part").filter(rules.violation({"rule_type": "range", "column": "p_size", "minimum": 5, "max": 40})).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 = 0 OR o_orderstatus NOT IN ('O', 'F')")
def rule_allowed_values(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return o.filter(rules.violation({"rule_type": "allowed_values", "column": "s", "values": ["O", "F"]})).select("o_orderkey", "o_orderstatus")


LINE_ORDER = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def line_orders(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate FROM {LINE_ORDER} WHERE o_orderdate > l_shipdate")
def rule_date_order(spark, d):
    bad = rules.violation({"rule_type": "date_order", "start": "o_orderdate", "end": "l_shipdate"})
    return line_orders(spark, d).filter(bad).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate")


LINE_RULES = [
    {"name": "quantity_range", "rule_type": "range", "column": "l_quantity", "min": 2, "max": 48},
    {"name": "tax_not_null", "rule_type": "not_null", "column": "tax"},
    {"name": "flags", "rule_type": "allowed_values", "column": "l_returnflag", "values": ["A", "N"]},
    {"name": "switched_off", "rule_type": "non_negative", "column": "l_discount", "is_active": False},
]


def ruled_lines(spark, d):
    return table(spark, d, "lineitem").withColumn("tax", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_tax")))


@query("""WITH v AS (SELECT l_quantity < 2 OR l_quantity > 48 AS a, l_orderkey % 10 = 0 AS b, l_returnflag NOT IN ('A', 'N') AS c FROM lineitem), s AS (SELECT count(*) AS total_rows, count(*) FILTER (a OR b OR c) AS invalid_rows, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c FROM v)
SELECT 'quantity_range' AS rule, a AS violations, total_rows, invalid_rows FROM s UNION ALL SELECT 'tax_not_null', b, total_rows, invalid_rows FROM s UNION ALL SELECT 'flags', c, total_rows, invalid_rows FROM s""")
def rule_report(spark, d):
    return rules.report(ruled_lines(spark, d), LINE_RULES)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity < 2 OR l_quantity > 48 OR l_orderkey % 10 = 0 OR l_returnflag NOT IN ('A', 'N'))")
def rule_reject_rows(spark, d):
    return rules.valid_rows(ruled_lines(spark, d), LINE_RULES).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


def net_lines(spark, d):
    net = F.col("l_extendedprice") * F.col("l_discount")
    cut = F.when(F.col("l_orderkey") % 500 == 0, 0.0).otherwise(net)
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), cut.alias("rebate"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("gross"), F.col("l_quantity").alias("quantity"))


NET = "SELECT l_extendedprice AS price, l_discount AS discount, CASE WHEN l_orderkey % 500 = 0 THEN 0 ELSE l_extendedprice * l_discount END AS rebate, l_extendedprice + l_quantity AS gross, l_quantity AS quantity FROM lineitem"
TRIED = (("multiply", "*", "price", "discount", "rebate"), ("add", "+", "price", "quantity", "gross"), ("subtract", "-", "gross", "quantity", "price"), ("subtract", "-", "gross", "price", "quantity"), ("divide", "/", "rebate", "discount", "price"), ("divide", "/", "rebate", "price", "discount"), ("divide", "/", "rebate", "gross", "discount"))


def detected_sql() -> str:
    """The rules of ``arithmetic_rule_scan`` whose target correlates with an operand."""
    rows = [f"SELECT '{op}' AS operation, '{a}' AS left_column, '{b}' AS right_column, '{t}' AS target, avg((abs({a} {sign} {b} - {t}) <= 0.01 + 1e-5 * abs({t}))::int) {f'FILTER ({b} <> 0)' if op == 'divide' else ''} AS accuracy, greatest(abs(corr({a}, {t})), abs(corr({b}, {t}))) AS related FROM v" for op, sign, a, b, t in TRIED]
    return f"WITH v AS ({NET}), c AS ({' UNION ALL '.join(rows)}) SELECT operation, left_column, right_column, target, round(accuracy, 6) AS accuracy FROM c WHERE accuracy >= 0.99 AND related >= 0.7"


@query("""WITH v AS (SELECT l_extendedprice AS price, l_discount AS discount, CASE WHEN l_orderkey % 500 = 0 THEN 0 ELSE l_extendedprice * l_discount END AS rebate, l_extendedprice + l_quantity AS gross, l_quantity AS quantity FROM lineitem),
c AS (SELECT 'multiply' AS operation, 'price' AS left_column, 'discount' AS right_column, 'rebate' AS target, avg((abs(price * discount - rebate) <= 0.01 + 1e-5 * abs(rebate))::int) AS accuracy FROM v
UNION ALL SELECT 'add', 'price', 'quantity', 'gross', avg((abs(price + quantity - gross) <= 0.01 + 1e-5 * abs(gross))::int) FROM v
UNION ALL SELECT 'subtract', 'gross', 'quantity', 'price', avg((abs(gross - quantity - price) <= 0.01 + 1e-5 * abs(price))::int) FROM v
UNION ALL SELECT 'subtract', 'gross', 'price', 'quantity', avg((abs(gross - price - quantity) <= 0.01 + 1e-5 * abs(quantity))::int) FROM v
UNION ALL SELECT 'divide', 'rebate', 'discount', 'price', avg((abs(rebate / discount - price) <= 0.01 + 1e-5 * abs(price))::int) FILTER (discount <> 0) FROM v
UNION ALL SELECT 'divide', 'rebate', 'price', 'discount', avg((abs(rebate / price - discount) <= 0.01 + 1e-5 * abs(discount))::int) FILTER (price <> 0) FROM v
UNION ALL SELECT 'divide', 'rebate', 'gross', 'discount', avg((abs(rebate / gross - discount) <= 0.01 + 1e-5 * abs(discount))::int) FILTER (gross <> 0) FROM v)
SELECT operation, left_column, right_column, target, round(accuracy, 6) AS accuracy FROM c WHERE accuracy >= 0.99""")
def arithmetic_rule_scan(spark, d):
    found = rules.scan_arithmetic(net_lines(spark, d))
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query(detected_sql())
def arithmetic_rules_detected(spark, d):
    found = rules.detect_arithmetic(net_lines(spark, d))
    rows = [(r["operation"], *r["operands"], r["target"], round(r["confidence"], 6)) for r in found]
    return spark.createDataFrame(rows, "operation string, left_column string, right_column string, target string, accuracy double")


#: A wider table, in the order of its column names; some columns follow from others.
WIDE = {"a": "l_extendedprice", "b": "l_discount", "c": "l_tax", "d": "l_quantity", "e": "l_extendedprice * l_discount", "f": "l_extendedprice + l_quantity", "g": "l_quantity - l_discount", "h": "l_linenumber", "i": "l_quantity / (l_linenumber + 1)", "j": "l_linenumber + 1"}


def wide_sql() -> str:
    """Every triple of ``WIDE`` on every row."""
    columns = ", ".join(f"({x})::double AS {c}" for c, x in WIDE.items())
    return f"""WITH v AS (SELECT row_number() OVER () AS r, {columns} FROM lineitem), u AS (UNPIVOT v ON {', '.join(WIDE)} INTO NAME c VALUE x), n AS (SELECT count(*) AS n FROM v), z AS (SELECT c, count(*) FILTER (x <> 0) AS d FROM u GROUP BY c),
t AS (SELECT a.c AS l, b.c AS r, t.c AS t, list_value(('add', a.x + b.x), ('subtract', a.x - b.x), ('multiply', a.x * b.x), ('divide', CASE WHEN b.x <> 0 THEN a.x / b.x END)) AS made, t.x AS x FROM u a JOIN u b ON a.r = b.r AND a.c <> b.c JOIN u t ON t.r = a.r AND t.c <> a.c AND t.c <> b.c),
h AS (SELECT made[i][1] AS operation, l, t.r AS r, t, count(*) FILTER (abs(made[i][2] - x) <= 0.01 + 1e-5 * abs(x)) AS hits FROM t, (VALUES (1), (2), (3), (4)) k(i) WHERE i IN (2, 4) OR l < t.r GROUP BY ALL)
SELECT operation, l AS left_column, h.r AS right_column, t AS target, round(hits::double / CASE WHEN operation = 'divide' THEN d ELSE n END, 6) AS accuracy FROM h JOIN z ON z.c = h.r, n WHERE hits::double / CASE WHEN operation = 'divide' THEN d ELSE n END >= 0.95"""


@query(wide_sql())
def arithmetic_rules_wide(spark, d):
    wide = table(spark, d, "lineitem").select(*(F.expr(x).cast("double").alias(c) for c, x in WIDE.items()))
    return rules.scan_arithmetic(wide, least=0.95).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH v AS (SELECT (epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0::double AS days FROM {LINE_ORDER})
SELECT 'o_orderdate' AS first_column, 'l_shipdate' AS second_column, count(*) AS pairs, round(avg((days >= 0)::int), 6) AS forward, round(avg((days <= 0)::int), 6) AS backward, round(quantile_cont(days, 0.995) FILTER (days >= 0), 4) AS p995_forward, round(quantile_cont(-days, 0.995) FILTER (days <= 0), 4) AS p995_backward FROM v""")
def chronology_rule(spark, d):
    out = rules.chronology(line_orders(spark, d), [("o_orderdate", "l_shipdate")])
    return out.select("first_column", "second_column", "pairs", *(F.round(c, 6).alias(c) for c in ("forward", "backward")), *(F.round(c, 4).alias(c) for c in ("p995_forward", "p995_backward")))


REBATE = {"rule_type": "arithmetic", "operation": "multiply", "operands": ["price", "discount"], "target": "rebate"}


@query("""SELECT round(100.0::double * avg((abs(p * q - r) <= 0.01 + 1e-3 * abs(r) AND coalesce(l_quantity - 2 >= 0, false))::int), 4) AS validity FROM (SELECT l_extendedprice AS p, l_discount AS q, CASE WHEN l_orderkey % 500 = 0 THEN 0 ELSE l_extendedprice * l_discount END AS r, l_quantity FROM lineitem)""")
def domain_validity(spark, d):
    lines = net_lines(spark, d).withColumn("above", F.col("quantity") - 2)
    return rules.domain_validity(lines, [REBATE, {"rule_type": "non_negative", "target": "above"}])


@query("SELECT round(l_extendedprice, 4) AS price, l_discount AS discount, l_quantity AS quantity, round(l_extendedprice * l_discount, 4) AS rebate FROM lineitem")
def reconstruct_derived(spark, d):
    out = rules.apply_arithmetic(net_lines(spark, d), [REBATE])
    return out.select(F.round("price", 4).alias("price"), "discount", "quantity", F.round("rebate", 4).alias("rebate"))


def damaged_orders(spark, d, repaired: bool = False):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    late = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), F.when(k % 13 == 0, -3).otherwise(5)), "yyyy-MM-dd")
    o = o.select("o_custkey", F.when(k % 10 != 0, F.col("o_orderpriority")).otherwise("x" if repaired else " ").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), late.alias("delivery_date"))
    return o.unionByName(o.filter(F.col("o_custkey") % 20 == 0)) if not repaired else o


QUALITY = """WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN '{blank}' ELSE o_orderpriority END AS priority, o_orderdate::date AS s, o_orderdate::date + CASE WHEN o_orderkey % 13 = 0 THEN -3 ELSE 5 END AS e FROM orders), u AS (SELECT * FROM o {more}),
g AS (SELECT count(*) AS n, count(*) FILTER (trim(priority) = '') AS m, count(*) FILTER (e < s) AS bad FROM u), x AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM u))
SELECT 'completeness' AS metric, round(100.0::double - m * 100.0::double / (n * 4), 4) AS value FROM g UNION ALL SELECT 'duplicate_rate', round((n - d) * 100.0::double / n, 4) FROM g, x UNION ALL SELECT 'date_violation_rate', round(bad * 100.0::double / n, 4) FROM g"""
MORE = "UNION ALL SELECT * FROM o WHERE o_custkey % 20 = 0"


@query(QUALITY.format(blank=" ", more=MORE))
def quality_metrics(spark, d):
    return rules.quality_metrics(damaged_orders(spark, d))


@query(f"""WITH b AS ({QUALITY.format(blank=' ', more=MORE)}), a AS ({QUALITY.format(blank='x', more='')})
SELECT metric, b.value AS value_before, a.value AS value_after, round(a.value - b.value, 4) AS delta, CASE WHEN sign(a.value - b.value) * CASE WHEN metric = 'completeness' THEN 1 ELSE -1 END > 0 THEN 'improved' WHEN round(a.value - b.value, 4) = 0 THEN 'unchanged' ELSE 'regressed' END AS status FROM b JOIN a USING (metric)""")
def metric_delta(spark, d):
    return rules.metric_delta(rules.quality_metrics(damaged_orders(spark, d)), rules.quality_metrics(damaged_orders(spark, d, True)))
