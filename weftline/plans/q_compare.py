"""Comparison queries: even keys play the real table, odd keys the synthetic one."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import alike, compare, text
from weftline.plans.registry import query, table


def halves(df, key: str):
    return df.filter(F.col(key) % 2 == 0), df.filter(F.col(key) % 2 != 0)


def ks_sql(name: str, key: str, columns) -> str:
    cases = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::double AS v, {key} % 2 AS s FROM {name}" for c in columns)
    return f"""WITH u AS ({cases}), g AS (SELECT column_name, v, count(*) FILTER (s = 0) AS nr, count(*) FILTER (s <> 0) AS ns FROM u GROUP BY ALL),
c AS (SELECT column_name, sum(nr) OVER (PARTITION BY column_name ORDER BY v)::double / sum(nr) OVER (PARTITION BY column_name) AS fr, sum(ns) OVER (PARTITION BY column_name ORDER BY v)::double / sum(ns) OVER (PARTITION BY column_name) AS fs FROM g)
SELECT column_name, max(abs(fr - fs)) AS ks FROM c GROUP BY column_name"""


LINE = ("l_quantity", "l_extendedprice", "l_discount")


@query(f"SELECT column_name, round(ks, 6) AS ks_statistic FROM ({ks_sql('lineitem', 'l_orderkey', LINE)}) UNION ALL SELECT column_name, round(ks, 6) FROM ({ks_sql('events', 'event_id', ('value',))})")
def ks_numeric(spark, d):
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    er, es = halves(table(spark, d, "events"), "event_id")
    return compare.ks(real, synthetic, list(LINE)).unionByName(compare.ks(er, es, ["value"])).withColumn("ks_statistic", F.round("ks_statistic", 6))


MOMENTS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg({c}) FILTER (l_orderkey % 2 = 0) AS m1, avg({c}) FILTER (l_orderkey % 2 <> 0) AS m2, stddev_samp({c}) FILTER (l_orderkey % 2 = 0) AS s1, stddev_samp({c}) FILTER (l_orderkey % 2 <> 0) AS s2 FROM lineitem" for c in LINE)


@query(f"""WITH m AS ({MOMENTS}), k AS ({ks_sql('lineitem', 'l_orderkey', LINE)}), j AS (SELECT column_name, 1 - least(abs(m1 - m2) / greatest(s1, 1e-9), 1) AS a, 1 - least(abs(s1 - s2) / greatest(s1, 1e-9), 1) AS b, ks FROM m JOIN k USING (column_name))
SELECT column_name, round(a, 4) AS mean_similarity, round(b, 4) AS std_similarity, round(ks, 4) AS ks_statistic, round((a + b + 1 - ks) / 3 * 100, 4) AS score FROM j""")
def numeric_similarity(spark, d):
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    return compare.numeric_similarity(real, synthetic, list(LINE))


def shares_sql(name: str, key: str, columns) -> str:
    cases = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::varchar AS v, {key} % 2 AS s FROM {name}" for c in columns)
    return f"""u AS ({cases}), g AS (SELECT column_name, v, count(*) FILTER (s = 0) AS nr, count(*) FILTER (s <> 0) AS ns FROM u GROUP BY ALL), p AS (SELECT column_name, v, nr::double / sum(nr) OVER (PARTITION BY column_name) AS p, ns::double / sum(ns) OVER (PARTITION BY column_name) AS q FROM g)"""


@query(f"""WITH {shares_sql('orders', 'o_orderkey', ('o_orderstatus', 'o_orderpriority'))}, j AS (SELECT column_name, sqrt(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END))) AS d FROM p GROUP BY 1)
SELECT column_name, round(d, 4) AS js_distance, round(greatest(0, 1 - d) * 100, 4) AS score FROM j""")
def js_categorical(spark, d):
    real, synthetic = halves(table(spark, d, "orders"), "o_orderkey")
    return compare.js_distance(real, synthetic, ["o_orderstatus", "o_orderpriority"])


@query(f"""WITH {shares_sql('part', 'p_partkey', ('p_type', 'p_brand'))}, r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY p + q DESC, v) AS place FROM p)
SELECT column_name, CASE WHEN place <= 10 THEN v ELSE 'Other' END AS value, round(sum(p), 6) AS p, round(sum(q), 6) AS q FROM r GROUP BY 1, 2""")
def category_top10_other(spark, d):
    from weftline.operators import profile

    real, synthetic = halves(table(spark, d, "part"), "p_partkey")
    out = compare.top_and_other(compare.value_counts(real, synthetic, ["p_type", "p_brand"], profile.text_long))
    return out.select("column_name", "value", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query(f"WITH {shares_sql('customer', 'c_custkey', ('c_mktsegment', 'c_nationkey'))} SELECT column_name, round(sum(abs(p - q)) / 2, 4) AS tvd FROM p GROUP BY 1")
def tvd_categorical(spark, d):
    real, synthetic = halves(table(spark, d, "customer"), "c_custkey")
    return compare.tvd(real, synthetic, ["c_mktsegment", "c_nationkey"])


def similarity_sql(name: str, key: str, numbers, labels) -> str:
    side = lambda f, c, s: f"{f}({c}) FILTER ({key} % 2 {'=' if s else '<>'} 0)"
    m = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {side('avg', c, 1)} AS m1, {side('avg', c, 0)} AS m2, {side('stddev_samp', c, 1)} AS s1, {side('stddev_samp', c, 0)} AS s2 FROM {name}" for c in numbers)
    return f"""WITH m AS ({m}), k AS ({ks_sql(name, key, numbers)}), n AS (SELECT column_name, 'numerical' AS kind, (1 - least(abs(m1 - m2) / greatest(s1, 1e-9), 1) + 1 - least(abs(s1 - s2) / greatest(s1, 1e-9), 1) + 1 - ks) / 3 * 100 AS score FROM m JOIN k USING (column_name)), {shares_sql(name, key, labels)},
j AS (SELECT column_name, sqrt(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END))) AS d FROM p GROUP BY 1)
SELECT column_name, kind, round(score, 4) AS score FROM n UNION ALL SELECT column_name, 'categorical', round(greatest(0, 1 - d) * 100, 4) FROM j"""


@query(similarity_sql("part", "p_partkey", ("p_partkey", "p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")))
def statistical_similarity(spark, d):
    real, synthetic = halves(table(spark, d, "part"), "p_partkey")
    return compare.statistical_similarity(real, synthetic)


CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS correlation FROM lineitem" for a, b in PAIRS))
def corr_matrix_long(spark, d):
    return compare.correlation_long(table(spark, d, "lineitem"), list(CORR)).withColumn("correlation", F.round("correlation", 4))


@query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(covar_samp({a}, {b}), 4) AS covariance FROM lineitem" for i, a in enumerate(CORR[1:]) for b in CORR[1:][i:]))
def cov_matrix_long(spark, d):
    return compare.covariance_long(table(spark, d, "lineitem"), list(CORR[1:])).withColumn("covariance", F.round("covariance", 4))


def preservation_sql() -> str:
    gap, num, den = [], [], ["4"]
    for a, b in PAIRS:
        r, s = f"corr({a}, {b}) FILTER (l_orderkey % 2 = 0)", f"corr({a}, {b}) FILTER (l_orderkey % 2 <> 0)"
        gap.append(f"2 * abs({r} - {s})")
        num.append(f"2 * pow({r} - {s}, 2)")
        den.append(f"2 * pow({r}, 2)")
    cov = []
    for i, a in enumerate(CORR):
        for b in CORR[i:]:
            r, s = f"covar_samp({a}, {b}) FILTER (l_orderkey % 2 = 0)", f"covar_samp({a}, {b}) FILTER (l_orderkey % 2 <> 0)"
            scale = f"greatest(stddev_samp({a}) FILTER (l_orderkey % 2 = 0) * stddev_samp({b}) FILTER (l_orderkey % 2 = 0), 1e-9)"
            cov.append(f"{1 if a == b else 2} * least(abs({r} - {s}) / {scale}, 1)")
    return f"""WITH x AS (SELECT ({' + '.join(gap)}) / 16 AS gap, ({' + '.join(cov)}) / 16 AS cgap, sqrt({' + '.join(num)}) AS num, sqrt({' + '.join(den)}) AS den FROM lineitem), y AS (SELECT greatest(0, 1 - gap / 2) * 100 AS c, greatest(0, 1 - cgap) * 100 AS v, num / den AS e FROM x)
SELECT round(c, 4) AS correlation_score, round(v, 4) AS covariance_score, round((c + v) / 2, 4) AS overall_score, round(e, 4) AS correlation_error FROM y"""


@query(preservation_sql())
def corr_preservation(spark, d):
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    return compare.correlation_preservation(real, synthetic, list(CORR))


def cramers_sql(where: str = "true") -> str:
    return f"""SELECT 'o_orderstatus' AS column_a, 'o_orderpriority' AS column_b, round(coalesce(sqrt(phi / nullif(least(k - pow(k - 1, 2) / (n - 1) - 1, m - pow(m - 1, 2) / (n - 1) - 1), 0)), 0), 4) AS cramers_v FROM (
SELECT n, k, m, greatest(0, q - 1 - (k - 1) * (m - 1) / (n - 1)::double) AS phi FROM (SELECT sum(o)::double AS n, sum(pow(o, 2)::double / (r * c)) AS q, count(DISTINCT x) AS k, count(DISTINCT y) AS m FROM (
SELECT x, y, o, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS c FROM (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS o FROM orders WHERE {where} GROUP BY ALL))))"""


@query(cramers_sql())
def cramers_v(spark, d):
    return compare.cramers_v(table(spark, d, "orders"), [("o_orderstatus", "o_orderpriority")])


@query(f"SELECT round((1 - abs(a.cramers_v - b.cramers_v)) * 100, 4) AS association_score FROM ({cramers_sql('o_orderkey % 2 = 0')}) a, ({cramers_sql('o_orderkey % 2 <> 0')}) b")
def association_preservation(spark, d):
    real, synthetic = halves(table(spark, d, "orders"), "o_orderkey")
    return compare.association_preservation(real, synthetic, ["o_orderstatus", "o_orderpriority"])


@query("""WITH s AS (SELECT l_quantity, l_discount, l_tax, l_suppkey FROM lineitem WHERE l_orderkey % 2 <> 0), r AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT count(*) AS rows, count(r.l_quantity) AS exact_matches, round(count(r.l_quantity)::double / count(*), 6) AS exact_match_rate FROM s LEFT JOIN r ON s.l_quantity = r.l_quantity AND s.l_discount = r.l_discount AND s.l_tax = r.l_tax AND s.l_suppkey = r.l_suppkey""")
def exact_match_rate(spark, d):
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    return compare.exact_matches(real, synthetic, ["l_quantity", "l_discount", "l_tax", "l_suppkey"])


@query("SELECT p_partkey, p_brand, p_size FROM part s WHERE p_partkey % 2 <> 0 AND NOT EXISTS (SELECT 1 FROM part r WHERE r.p_partkey % 2 = 0 AND r.p_brand = s.p_brand AND r.p_size = s.p_size)")
def privacy_guard_anti(spark, d):
    real, synthetic = halves(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return compare.without_copies(real, synthetic, ["p_brand", "p_size"])


GOWER = """WITH c AS (SELECT c_custkey AS k, c_acctbal AS x, c_mktsegment AS y, md5(c_custkey::varchar || '|42') AS h FROM customer), r AS (SELECT * FROM c WHERE k % 2 = 0 ORDER BY h LIMIT 2000), s AS (SELECT * FROM c WHERE k % 2 <> 0 ORDER BY h LIMIT 500),
g AS (SELECT max(x) - min(x) AS w FROM c WHERE k % 2 = 0), near AS (SELECT s.k, min((least(abs(s.x - r.x) / w, 1) + (s.y <> r.y)::int) / 2.0::double) AS d FROM s, r, g GROUP BY 1)"""


@query(GOWER + " SELECT k AS key, round(d, 6) AS distance FROM near")
def gower_dcr(spark, d):
    c = table(spark, d, "customer")
    real, synthetic = halves(c.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    from weftline.functions.exprs import md5_order

    low, high = real.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    sample = lambda df, n: df.orderBy(md5_order("c_custkey")).limit(n)
    near = compare.gower_nearest(sample(synthetic, 500), sample(real, 2000), ["c_acctbal"], ["c_mktsegment"], {"c_acctbal": high - low}, "c_custkey")
    return near.withColumn("distance", F.round("distance", 6))


PRIVACY = """WITH c AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey AS n, c_mktsegment AS y, md5(c_custkey::varchar || '|42') AS h FROM customer), w AS (SELECT max(x) - min(x) AS wx, max(n) - min(n) AS wn FROM c WHERE k % 2 = 0),
r AS (SELECT * FROM c WHERE k % 2 = 0 ORDER BY h LIMIT 2000), s AS (SELECT * FROM c WHERE k % 2 <> 0 ORDER BY h LIMIT 500), o AS (SELECT * FROM r ORDER BY h LIMIT 500),
ds AS (SELECT s.k, min((least(abs(s.x - r.x) / wx, 1) + least(abs(s.n - r.n) / wn::double, 1) + (s.y <> r.y)::int) / 3.0::double) AS d FROM s, r, w GROUP BY 1), dr AS (SELECT o.k, min((least(abs(o.x - r.x) / wx, 1) + least(abs(o.n - r.n) / wn::double, 1) + (o.y <> r.y)::int) / 3.0::double) AS d FROM o, r, w WHERE o.k <> r.k GROUP BY 1),
e AS (SELECT count(*) FILTER (EXISTS (SELECT 1 FROM c r WHERE r.k % 2 = 0 AND r.x = c.x AND r.n = c.n AND r.y = c.y))::double / count(*) AS x FROM c WHERE k % 2 <> 0),
m AS (SELECT round((SELECT x FROM e), 6) AS x, (SELECT median(d) FROM ds) AS s, (SELECT median(d) FROM dr) AS r), q AS (SELECT *, CASE WHEN r > 0 THEN s / r WHEN s > 0 THEN 1.0::double ELSE 0.0::double END AS ratio FROM m)
SELECT x AS exact_match_rate, round(s, 6) AS dcr_synthetic, round(r, 6) AS dcr_real, round(ratio, 4) AS dcr_ratio, round(50 * (1 - x) + 50 * least(1.0::double, ratio), 4) AS score, CASE WHEN x > 0.05 OR ratio < 0.5 THEN 'HIGH' WHEN x > 0.01 OR ratio < 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM q"""


@query(PRIVACY)
def privacy_score(spark, d):
    real, synthetic = halves(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"), "c_custkey")
    return compare.privacy(real, synthetic, "c_custkey")


GRADE = "CASE WHEN {0} >= 85 THEN 'excellent' WHEN {0} >= 70 THEN 'good' WHEN {0} >= 50 THEN 'fair' WHEN {0} IS NOT NULL THEN 'poor' ELSE 'not_available' END"


@query(f"""WITH m AS (SELECT round(avg(CASE WHEN c_acctbal > 0 THEN least(100, c_acctbal / 60) END) FILTER (c_mktsegment <> 'BUILDING'), 2) AS s FROM customer) SELECT s AS overall_score, {GRADE.format('s')} AS grade FROM m""")
def composite_score(spark, d):
    """Accounts play metrics; those of one segment play privacy, which does not count."""
    score = F.when(F.col("c_acctbal") > 0, F.least(F.lit(100.0), F.col("c_acctbal") / 60))
    return compare.composite(table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "privacy").otherwise("text").alias("metric"), score.alias("score")))


@query(f"SELECT c_custkey, {GRADE.format('(CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 100 END)')} AS grade FROM customer")
def grades(spark, d):
    return table(spark, d, "customer").select("c_custkey", compare.grade(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / 100)).alias("grade"))


def bench_docs(spark, d):
    return table(spark, d, "benchmark"), table(spark, d, "documents")


TRIM = "trim(text)"


@query("SELECT count(*) AS rows, count(DISTINCT trim(text)) AS distinct_rows, round((count(*) - count(DISTINCT trim(text)))::double / count(*), 6) AS duplicate_rate FROM documents WHERE trim(text) <> ''")
def text_duplicates(spark, d):
    return text.duplicate_rate(table(spark, d, "documents"), "text")


@query("""WITH s AS (SELECT lower(trim(text)) AS t FROM documents WHERE doc_id % 2 <> 0 AND trim(text) <> ''), r AS (SELECT DISTINCT lower(trim(text)) AS t FROM documents WHERE doc_id % 2 = 0 AND trim(text) <> '')
SELECT count(*) AS rows, count(r.t) AS verbatim, round(1 - count(r.t)::double / count(*), 6) AS originality FROM s LEFT JOIN r ON s.t = r.t""")
def text_verbatim(spark, d):
    real, synthetic = halves(table(spark, d, "documents"), "doc_id")
    return text.verbatim_rate(real, synthetic, "text")


@query("""WITH w AS (SELECT item_id AS k, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM benchmark), a AS (SELECT avg(length(t)) FILTER (k % 2 = 0) AS rc, avg(length(t)) FILTER (k % 2 <> 0) AS sc, avg(n) FILTER (k % 2 = 0) AS rw, avg(n) FILTER (k % 2 <> 0) AS sw FROM w WHERE t <> '')
SELECT round(rc, 4) AS real_chars, round(sc, 4) AS synthetic_chars, round(rw, 4) AS real_words, round(sw, 4) AS synthetic_words, round(100 * (1 - least(abs(rc - sc) / greatest(rc, 1), 1)), 4) AS length_score FROM a""")
def text_length(spark, d):
    real, synthetic = halves(table(spark, d, "benchmark"), "item_id")
    return text.length_similarity(real, synthetic, "text")


@query("""WITH t AS (SELECT item_id % 2 AS s, unnest(regexp_split_to_array(lower(trim(text)), '[^\\p{L}\\p{N}_]+')) AS w FROM benchmark), k AS (SELECT * FROM t WHERE regexp_matches(w, '^[a-z]{3,}$')), r AS (SELECT DISTINCT w FROM k WHERE s = 0), y AS (SELECT DISTINCT w FROM k WHERE s <> 0)
SELECT (SELECT count(*) FROM r JOIN y USING (w)) AS shared, (SELECT count(DISTINCT w) FROM k) AS total, round((SELECT count(*) FROM r JOIN y USING (w))::double / (SELECT count(DISTINCT w) FROM k), 6) AS jaccard, round((SELECT count(*) FROM y)::double / (SELECT count(*) FROM k WHERE s <> 0), 6) AS lexical_diversity""")
def text_vocab_jaccard(spark, d):
    real, synthetic = halves(table(spark, d, "benchmark"), "item_id")
    return text.vocabulary_overlap(real, synthetic, "text")


@query()
def text_near_duplicates(spark, d):
    return text.near_duplicates(table(spark, d, "documents"), "text", "doc_id")


def phrase_sql(phrases) -> str:
    return "regexp_matches(lower(t), '\\b(" + "|".join(p.replace("'", "''") for p in phrases) + ")\\b')"


def opinions(spark, d):
    """Short opinions made from keys, so that every phrase list is hit."""
    t = F.element_at(F.array(*(F.lit(x) for x in OPINIONS)), (F.pmod("c_custkey", F.lit(len(OPINIONS))) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", t.alias("t"), F.when(F.col("c_custkey") % 2 == 0, "positive").otherwise("negative").alias("label"), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int").alias("stars"))


OPINIONS = ("It worked very well and I am happy", "The seal was damaged and the smell awful", "A little late but great", "Nothing to say", "could be better", "I love it, highly recommend", "useless and slow", " ", "Not effective, poor quality but excellent support")


def opinion_sql() -> str:
    from weftline.functions import words as w

    cases = ", ".join("'" + o.replace("'", "''") + "'" for o in OPINIONS)
    rows = f"WITH o AS (SELECT c_custkey, ([{cases}])[(c_custkey % {len(OPINIONS)}) + 1] AS t, CASE WHEN c_custkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS label, (c_custkey % 5 + 1)::int AS stars FROM customer), f AS (SELECT *, {phrase_sql(w.POSITIVE + w.MORE_POSITIVE)} AS up, {phrase_sql(w.STRONG_NEGATIVE + w.MORE_NEGATIVE)} AS down, {phrase_sql(w.STRONG_NEGATIVE)} AS bad, {phrase_sql(w.MILD_ISSUE)} AS mild, {phrase_sql(w.POSITIVE)} AS good FROM o)"
    return f"{rows} SELECT c_custkey, trim(t) <> '' AND CASE label WHEN 'positive' THEN NOT (down AND NOT up) ELSE NOT (up AND NOT down) END AS sentiment_fits, trim(t) <> '' AND CASE stars WHEN 1 THEN bad WHEN 2 THEN bad OR mild WHEN 3 THEN bad = good WHEN 4 THEN NOT bad AND good ELSE NOT bad AND good END AS rating_fits FROM f"


@query(opinion_sql())
def opinion_consistency(spark, d):
    o = opinions(spark, d)
    return o.select("c_custkey", text.sentiment_fits(F.col("t"), F.col("label")).alias("sentiment_fits"), text.rating_fits(F.col("t"), F.col("stars")).alias("rating_fits"))


@query("""SELECT conv_id, turn, conv_id % 4 <> 2 OR trim(text) = '' AS too_similar FROM conversations WHERE role = 'user'""")
def text_guard(spark, d):
    """Texts in capitals, with a mark more, written anew, and blank ones against the texts as they were; a long text with a mark more may count as new."""
    asked = table(spark, d, "conversations").filter("role = 'user'")
    short = F.char_length("text").between(6, 198)
    made = F.when(F.col("conv_id") % 4 == 1, F.when(short, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).when(F.col("conv_id") % 4 == 2, F.when(F.trim("text") == "", F.col("text")).otherwise(F.md5(F.concat_ws("-", "conv_id", "turn")))).when(F.col("conv_id") % 4 == 3, F.lit("  ")).otherwise(F.upper("text"))
    return alike.too_similar(asked.select("conv_id", "turn", made.alias("made")), "made", asked, "text").select("conv_id", "turn", "too_similar")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS a, c_nationkey::double AS b, c_mktsegment AS s FROM customer), g AS (SELECT max(a) - min(a) AS ra, max(b) - min(b) AS rb FROM c WHERE k % 2 = 0),
d AS (SELECT x.k, min((coalesce(least(abs(x.a - y.a) / ra, 1), 1) + least(abs(x.b - y.b) / rb, 1) + (x.s IS DISTINCT FROM y.s)::int) / 3) AS distance FROM c x, c y, g WHERE x.k % 2 <> 0 AND y.k % 2 = 0 GROUP BY x.k) SELECT k AS key, round(distance, 6) AS distance FROM d""")
def gower_nearest_whole(spark, d):
    """Every row of one half against every row of the other."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.col("c_mktsegment").alias("s"))
    real, synthetic = halves(c, "k")
    width = real.agg(*((F.max(x) - F.min(x)).alias(x) for x in "ab")).first().asDict()
    return compare.gower_nearest(synthetic, real, ["a", "b"], ["s"], width, "k", most=None).withColumn("distance", F.round("distance", 6))
