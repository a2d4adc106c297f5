"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import words
from weftline.operators import profile
from weftline.plans.registry import query, table

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey")


def numeric_sql(name: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, round(min({c})::double, 4) AS min_value, round(quantile_cont({c}::double, 0.25), 4) AS q1, "
        f"round(quantile_cont({c}::double, 0.5), 4) AS median_value, round(quantile_cont({c}::double, 0.75), 4) AS q3, round(max({c})::double, 4) AS max_value, round(avg({c}::double), 4) AS mean_value, round(stddev_samp({c}::double), 4) AS std_value FROM {name}"
        for c in columns
    )


@query(numeric_sql("lineitem", LINE))
def profile_numeric(spark, d):
    return profile.numeric(table(spark, d, "lineitem"), list(LINE))


@query("SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def profile_basic(spark, d):
    return profile.basic(table(spark, d, "lineitem"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS filled, count(DISTINCT {c}) AS distinct_count, min(length({c}))::int AS min_length, max(length({c}))::int AS max_length, round(avg(length({c})), 4) AS avg_length, round(count(DISTINCT {c})::double / count(*), 4) AS unique_ratio FROM {t}"
    for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"))
))
def profile_string_lengths(spark, d):
    return profile.string_lengths(table(spark, d, "customer"), ["c_name", "c_mktsegment"]).unionByName(profile.string_lengths(table(spark, d, "part"), ["p_name", "p_brand", "p_type"]))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)
SELECT 'o_totalprice' AS column_name, count(*) FILTER (o_totalprice IS NULL) AS missing_count, round(100.0::double * count(*) FILTER (o_totalprice IS NULL) / count(*), 2) AS missing_percentage FROM o
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (trim(o_orderstatus) = ''), round(100.0::double * count(*) FILTER (trim(o_orderstatus) = '') / count(*), 2) FROM o
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (trim(o_orderpriority) = ''), round(100.0::double * count(*) FILTER (trim(o_orderpriority) = '') / count(*), 2) FROM o""")
def profile_missing(spark, d):
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority"
    )
    return profile.missing_summary(o)


@query("""WITH v AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS value_count FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL
 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value_count DESC, value NULLS LAST)::int AS position FROM v) SELECT * FROM r WHERE position <= 20""")
def profile_topk_categories(spark, d):
    return profile.value_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).unionByName(profile.value_counts(table(spark, d, "part"), ["p_brand", "p_type"]))


@query(f"""WITH v AS (SELECT 'c_name' AS column_name, c_name AS value FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) UNION ALL SELECT 'mail', c_name || '@shop.example' FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100)
 UNION ALL SELECT 'phone', '+49 30 ' || (1000000 + c_custkey)::varchar FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100))
SELECT column_name, avg(regexp_matches(replace(value, '#', '-'), '{words.EMAIL}')::int) >= 0.8 AS email, avg(regexp_matches(replace(value, '#', '-'), '{words.PHONE}')::int) >= 0.8 AS phone, avg(regexp_matches(value, '{words.UUID}')::int) >= 0.8 AS uuid FROM v GROUP BY column_name""")
def profile_patterns(spark, d):
    first = table(spark, d, "customer").orderBy("c_custkey").limit(100)
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))
    return profile.patterns(first.select(name.alias("c_name"), F.concat(name, F.lit("@shop.example")).alias("mail"), F.concat(F.lit("+49 30 "), (F.col("c_custkey") + 1000000).cast("string")).alias("phone")))


@query("""WITH p AS (SELECT 'p_partkey' AS column_name, count(DISTINCT p_partkey) AS u, avg(length(p_partkey::varchar)) AS l, count(*) AS n, 'bigint' AS t FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name), avg(length(p_name)), count(*), 'string' FROM part
 UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), avg(length(p_brand)), count(*), 'string' FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type), avg(length(p_type)), count(*), 'string' FROM part
 UNION ALL SELECT 'part_key', count(DISTINCT p_partkey), avg(length(p_partkey::varchar)), count(*), 'bigint' FROM part UNION ALL SELECT 'f7', count(DISTINCT p_size), avg(length(p_size::varchar)), count(*), 'int' FROM part
 UNION ALL SELECT 'constant', 1, 1, count(*), 'string' FROM part)
SELECT column_name, action, action = 'new_id' AS is_identifier FROM (SELECT column_name, CASE WHEN u <= 1 THEN 'remove' WHEN regexp_matches(column_name, '^f\\d+$') THEN 'keep' WHEN regexp_matches(column_name, '(_id|_key)$') THEN 'new_id'
  WHEN t = 'string' AND column_name NOT LIKE '%type%' AND NOT (u > 0 AND u <= 20 AND l <= 24) AND (l >= 15 OR (l >= 8 AND u::double / n >= 0.3)) THEN 'llm' WHEN u::double / n > 0.85 AND (column_name LIKE '%id%' OR column_name LIKE '%code%' OR column_name LIKE '%num%') THEN 'new_id' ELSE 'keep' END AS action FROM p)""")
def classify_columns(spark, d):
    part = table(spark, d, "part")
    wide = part.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_partkey").alias("part_key"), F.col("p_size").alias("f7"), F.lit("x").alias("constant"))
    return profile.classify_columns(profile.classifier_input(wide))


def full_profile_sql(name: str, kinds: dict[str, tuple[str, str]], most: int = 10) -> str:
    """kinds: column -> (kind, Spark type)."""
    parts = []
    for c, (kind, dtype) in kinds.items():
        v = f"{c}::varchar"
        number, string = kind == "numerical", dtype == "string"
        best = f"(SELECT {v} AS v, count(*) AS n FROM {name} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {most})"
        stat = lambda f: f"round({f}, 4)" if number else "NULL::double"
        parts.append(f"""SELECT '{c}' AS column_name, '{dtype}' AS dtype, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c})::double / count(*), 6) AS unique_ratio, 0.0::double AS null_ratio, round(avg(length({v})), 6) AS avg_length, '{kind}' AS kind,
(SELECT '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}}' FROM {best}) AS top_values, (SELECT '[' || string_agg('"' || v || '"', ',' ORDER BY v) || ']' FROM {best}) AS sample_values,
{stat(f'min({c})')} AS min_value, {stat(f'quantile_cont({c}, 0.25)')} AS q1, {stat(f'quantile_cont({c}, 0.5)')} AS median_value, {stat(f'quantile_cont({c}, 0.75)')} AS q3, {stat(f'max({c})')} AS max_value, {stat(f'avg({c})')} AS mean_value, {stat(f'stddev_samp({c})')} AS std_value,
{f'min(length({c}))' if string else 'NULL::bigint'} AS min_length, {f'max(length({c}))' if string else 'NULL::bigint'} AS max_length FROM {name}""" if number else f"""SELECT '{c}', '{dtype}', count(DISTINCT {c}), round(count(DISTINCT {c})::double / count(*), 6), 0.0::double, round(avg(length({v})), 6), '{kind}',
(SELECT '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}}' FROM {best}), (SELECT '[' || string_agg('"' || v || '"', ',' ORDER BY v) || ']' FROM {best}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, min(length({c})), max(length({c})) FROM {name}""")
    return " UNION ALL ".join(parts)


@query(full_profile_sql("part", {"p_partkey": ("numerical", "bigint"), "p_size": ("numerical", "int"), "p_name": ("categorical", "string"), "p_brand": ("categorical", "string"), "p_type": ("categorical", "string")}))
def full_profile(spark, d):
    out = profile.full_profile(table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type"))
    return out.withColumns({"unique_ratio": F.round("unique_ratio", 6), "avg_length": F.round("avg_length", 6)})
