"""Comparing a real table with a synthetic one.

The two tables are tagged, unpivoted and grouped by (column, value), so a distribution of
any size is compared by grouped counts and windows per column. Metrics come back as rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.functions import exprs, roles
from weftline.operators import nearest, profile


def common(real: DataFrame, synthetic: DataFrame) -> list[str]:
    return [c for c in real.columns if c in synthetic.columns]


def tagged(real: DataFrame, synthetic: DataFrame, columns: list[str], long) -> DataFrame:
    """(column_name, value, is_real) over both tables."""
    part = lambda df, flag: long(df, columns).withColumn("is_real", F.lit(flag))
    return part(real, 1).unionByName(part(synthetic, 0)).filter("value is not null")


def value_counts(real: DataFrame, synthetic: DataFrame, columns: list[str], long) -> DataFrame:
    """(column_name, value, nr, ns): how often each value stands on either side."""
    return tagged(real, synthetic, columns, long).groupBy("column_name", "value").agg(F.sum("is_real").alias("nr"), F.sum(1 - F.col("is_real")).alias("ns"))


def ks(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, ks_statistic): two-sample Kolmogorov-Smirnov distance."""
    cdf = profile.cumulative(value_counts(real, synthetic, columns, profile.numeric_long), ["nr", "ns"])
    share = lambda w: exprs.divide(F.col(f"before_{w}") + F.col(w), f"all_{w}")
    return cdf.groupBy("column_name").agg(F.max(F.abs(share("nr") - share("ns"))).alias("ks_statistic"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    return profile.numeric_long(df, columns).groupBy("column_name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def numeric_similarity(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mean_similarity, std_similarity, ks_statistic, score); two values a side at least."""
    r, s = moments(real, columns), moments(synthetic, columns).select("column_name", F.col("n").alias("n2"), F.col("mean").alias("mean2"), F.col("std").alias("std2"))
    both = r.join(s, "column_name").join(ks(real, synthetic, columns), "column_name").filter("n >= 2 and n2 >= 2")
    m = exprs.bounded_similarity(F.col("mean") - F.col("mean2"), F.col("std"))
    d = exprs.bounded_similarity(F.col("std") - F.col("std2"), F.col("std"))
    return both.select("column_name", F.round(m, 4).alias("mean_similarity"), F.round(d, 4).alias("std_similarity"), F.round("ks_statistic", 4).alias("ks_statistic"), F.round((m + d + 1 - F.col("ks_statistic")) / 3 * 100, 4).alias("score"))


def shares(counts: DataFrame) -> DataFrame:
    """Add ``all_r`` and ``all_s``, a column's totals, and the shares p and q (0 for an empty side)."""
    totals = counts.groupBy("column_name").agg(F.sum("nr").alias("all_r"), F.sum("ns").alias("all_s"))
    joined = counts.join(F.broadcast(totals), "column_name")  # one row per column
    return joined.withColumns({"p": F.coalesce(exprs.divide("nr", "all_r"), F.lit(0.0)), "q": F.coalesce(exprs.divide("ns", "all_s"), F.lit(0.0))})


def top_and_other(counts: DataFrame, keep: int = 10) -> DataFrame:
    """(column_name, value, p, q): shares of the ``keep`` commonest values and of all others together.

    The window keeps ``keep`` rows of a column in every task before it shuffles; the others
    are what is left of the totals.
    """
    place = Window.partitionBy("column_name").orderBy((F.col("p") + F.col("q")).desc(), "value")
    top = shares(counts).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= keep).select("column_name", "value", "nr", "ns")
    sizes = counts.groupBy("column_name").agg(F.sum("nr").alias("all_r"), F.sum("ns").alias("all_s"), F.count("*").alias("n"))
    held = top.groupBy("column_name").agg(F.sum("nr").alias("nr"), F.sum("ns").alias("ns"))
    rest = sizes.filter(F.col("n") > keep).join(held, "column_name").select("column_name", F.lit("Other").alias("value"), (F.col("all_r") - F.col("nr")).alias("nr"), (F.col("all_s") - F.col("ns")).alias("ns"))
    named = top.unionByName(rest).groupBy("column_name", "value").agg(F.sum("nr").alias("nr"), F.sum("ns").alias("ns"))  # a value may be called Other
    return shares(named).select("column_name", "value", "p", "q")


def js_distance(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, js_distance, score): Jensen-Shannon distance to base 2 of category shares."""
    known = shares(value_counts(real, synthetic, columns, profile.text_long)).filter("all_r > 0 and all_s > 0")
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    distance = F.sqrt(F.greatest(F.lit(0.0), F.sum(part("p")) / 2 + F.sum(part("q")) / 2))
    out = known.groupBy("column_name").agg(distance.alias("d"))
    return out.select("column_name", F.round("d", 4).alias("js_distance"), F.round(F.greatest(F.lit(0.0), 1 - F.col("d")) * 100, 4).alias("score"))


def tvd(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, tvd): total-variation distance of category shares."""
    known = shares(value_counts(real, synthetic, columns, profile.text_long)).filter("all_r > 0 and all_s > 0")
    return known.groupBy("column_name").agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 4).alias("tvd"))


def eligible(real: DataFrame, configs: dict[str, dict] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """Columns to compare with their roles, and the others with the reason."""
    found = roles.roles(real, configs)
    reasons = {"identifier": "identifier", "free_form_text": "free_form_text", "datetime": "datetime_not_supported", "unsupported": "unsupported"}
    return {c: r for c, r in found.items() if r not in reasons}, {c: reasons[r] for c, r in found.items() if r in reasons}


def statistical_similarity(real: DataFrame, synthetic: DataFrame, configs: dict[str, dict] | None = None) -> DataFrame:
    """(column_name, kind, score) of every comparable column; its mean is the overall score."""
    use, _ = eligible(real.select(*common(real, synthetic)), configs)
    numbers, labels = [c for c, r in use.items() if r == "numerical"], [c for c, r in use.items() if r == "categorical"]
    parts = []
    if numbers:
        parts.append(numeric_similarity(real, synthetic, numbers).select("column_name", F.lit("numerical").alias("kind"), "score"))
    if labels:
        parts.append(js_distance(real, synthetic, labels).select("column_name", F.lit("categorical").alias("kind"), "score"))
    if not parts:
        return real.sparkSession.createDataFrame([], "column_name string, kind string, score double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pair_stats(df: DataFrame, columns: list[str], f, name: str, pairs=None) -> DataFrame:
    """(column_a, column_b, {name}) over column pairs, in one aggregate per 80 pairs."""
    pairs = list(pairs or combinations(columns, 2))
    numbers, out = df.select(*(exprs.number(c).alias(c) for c in columns)), None
    for at in range(0, len(pairs), 80):
        part = pairs[at : at + 80]
        row = numbers.agg(*(f(a, b).alias(f"p{i}") for i, (a, b) in enumerate(part)))
        found = row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias(name)) for i, (a, b) in enumerate(part)))))
        out = found if out is None else out.unionByName(found)
    return out


def together(f):
    """An aggregate over rows where both columns have values."""
    return lambda a, b: f(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))


def correlation_long(df: DataFrame, columns: list[str]) -> DataFrame:
    safe = lambda a, b: F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return pair_stats(df, columns, together(safe), "correlation")


def covariance_long(df: DataFrame, columns: list[str]) -> DataFrame:
    return pair_stats(df, columns, together(F.covar_samp), "covariance", combinations_with_replacement(columns, 2))


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles; only those with gaps need their medians."""
    gaps = df.agg(*(F.count_if(exprs.number(c).isNull()).alias(c) for c in columns)).first()
    m = profile.quantiles(df, [c for c in columns if gaps[c]], [0.5]) if any(gaps) else {}
    return df.select(*(F.coalesce(exprs.number(c), F.lit(m.get(c, [0.0])[0])).alias(c) for c in columns))


def covariance_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariances of all pairs, in one aggregate per 80 pairs; missing ones are 0."""
    n = len(columns)
    pairs, out = list(combinations_with_replacement(range(n), 2)), np.zeros((n, n))
    for at in range(0, len(pairs), 80):
        part = pairs[at : at + 80]
        row = df.agg(*(F.covar_samp(columns[i], columns[j]).alias(f"p{k}") for k, (i, j) in enumerate(part))).first()
        for (i, j), v in zip(part, row):
            out[i, j] = out[j, i] = 0.0 if v is None or math.isnan(v) else v
    return out


def correlation_preservation(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(correlation_score, covariance_score, overall_score, correlation_error); null below two columns.

    Each side gives its covariances, a number for each pair of columns; the rest follows from these.
    """
    schema, n = "correlation_score double, covariance_score double, overall_score double, correlation_error double", len(columns)
    if n < 2:
        return real.sparkSession.createDataFrame([(None,) * 4], schema)
    vr, vs = (covariance_matrix(median_filled(df, columns), columns) for df in (real, synthetic))

    def correlations(v: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.outer(np.diag(v), np.diag(v)))
        out = np.divide(v, scale, out=np.zeros_like(v), where=scale > 0)
        np.fill_diagonal(out, 1.0)
        return out

    cr, cs, sd = correlations(vr), correlations(vs), np.sqrt(np.diag(vr))
    c = max(0.0, 1 - float(np.abs(cr - cs).sum()) / (n * n) / 2) * 100
    gap = np.minimum(np.abs(vr - vs) / np.maximum(np.outer(sd, sd), 1e-9), 1.0)
    v = max(0.0, 1 - float(gap.sum()) / (n * n)) * 100
    error = float(np.linalg.norm(cr - cs) / np.linalg.norm(cr))
    one = real.sparkSession.createDataFrame([(c, v, (c + v) / 2, error)], schema)
    return one.select(*(F.round(x, 4).alias(x) for x in one.columns))


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(column_a, column_b, cramers_v), bias-corrected, from grouped cell counts."""
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs)))).filter("x is not null and y is not null")
    key = ["column_a", "column_b"]
    o = cells.groupBy(*key, "x", "y").agg(F.count("*").alias("o"))
    o = o.withColumns({"r": F.sum("o").over(Window.partitionBy(*key, "x")), "c": F.sum("o").over(Window.partitionBy(*key, "y"))})
    s = o.groupBy(*key).agg(F.sum("o").alias("n"), F.sum(F.pow("o", F.lit(2.0)) / (F.col("r") * F.col("c"))).alias("q"), F.count_distinct("x").alias("k"), F.count_distinct("y").alias("m"))
    phi = F.greatest(F.lit(0.0), F.col("q") - 1 - exprs.divide((F.col("k") - 1) * (F.col("m") - 1), F.col("n") - 1))
    fix = lambda c: F.col(c) - exprs.divide(F.pow(F.col(c) - 1, 2), F.col("n") - 1)
    v = F.sqrt(exprs.divide(phi, F.least(fix("k") - 1, fix("m") - 1)))
    return s.select(*key, F.round(F.coalesce(v, F.lit(0.0)), 4).alias("cramers_v"))


def association_preservation(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(association_score): how well Cramer's V of all pairs is kept."""
    pairs = list(combinations(columns, 2))
    both = cramers_v(real, pairs).join(cramers_v(synthetic, pairs).withColumnRenamed("cramers_v", "other"), ["column_a", "column_b"])
    return both.agg(F.round((1 - F.avg(F.abs(F.col("cramers_v") - F.col("other")))) * 100, 4).alias("association_score"))


def exact_matches(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, exact_matches, exact_match_rate): synthetic rows that stand in the real table, nulls equal."""
    columns = columns or common(real, synthetic)
    key = lambda df: df.select(F.struct(*columns).alias("k"))
    keys = key(real).distinct().withColumn("hit", F.lit(1))
    joined = key(synthetic).join(keys.withColumnRenamed("k", "r"), F.col("k").eqNullSafe(F.col("r")), "left")
    return joined.agg(F.count("*").alias("rows"), F.count("hit").alias("exact_matches"), F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)), 6).alias("exact_match_rate"))


def without_copies(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Synthetic rows that are no copy of a real row in all columns that are not ids."""
    columns = columns or [c for c in common(real, synthetic) if not c.lower().endswith("_id")]
    keys = real.select(*(F.col(c).alias(f"_r_{c}") for c in columns)).distinct()
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return synthetic.join(keys, same, "left_anti")


def gower_nearest(queries: DataFrame, reference: DataFrame, numbers: list[str], labels: list[str], ranges: dict[str, float], key: str, itself: bool = False, most: int | None = 2000) -> DataFrame:
    """(key, distance): Gower distance from each query to its nearest reference row.

    The reference is a bounded sample (``most`` rows, those of the smallest hashes of their
    keys), held as one array beside each query row, so queries are spread over tasks and nothing
    is paired in rows. With ``most=None`` all of it counts (``nearest``).
    """
    if most is None:
        return nearest.gower_nearest_exact(queries, reference, numbers, labels, ranges, key, itself)
    keep = [F.col(key).alias("key"), *(exprs.number(c).alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in labels)]
    pool = reference.select(F.struct(*keep).alias("r")).orderBy(F.xxhash64("r.key"), "r.key").limit(most).agg(F.collect_list("r").alias("pool"))

    def distance(r) -> Column:
        gaps = [F.least(F.abs(F.col(c) - r[c]) / F.lit(float(ranges.get(c) or 1.0)), F.lit(1.0)) for c in numbers]
        gaps += [(~F.col(c).eqNullSafe(r[c])).cast("double") for c in labels]
        total = sum((F.coalesce(g, F.lit(1.0)) for g in gaps), F.lit(0.0)) / max(1, len(gaps))
        return F.when(r["key"].eqNullSafe(F.col("key")), None).otherwise(total) if itself else total

    rows = queries.select(*keep).withColumn("one", F.lit(1)).join(F.broadcast(pool.withColumn("one", F.lit(1))), "one")
    return rows.select("key", F.array_min(F.transform("pool", distance)).alias("distance"))


def medians(weighted: list[DataFrame]) -> list[float | None]:
    """The exact median of each table (distance, n), in which a distance stands n times; no task holds all of them."""
    named = [df.filter("distance is not null").select(F.lit(str(i)).alias("column_name"), F.col("distance").alias("value"), "n") for i, df in enumerate(weighted)]
    counts = reduce(DataFrame.unionByName, named).groupBy("column_name", "value").agg(F.sum("n").alias("n"))
    at = lambda rank: F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col("value")))
    middle = (F.col("all_n") - 1) / 2
    found = profile.cumulative(counts, ["n"]).groupBy("column_name").agg(((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("m")).collect()
    by = {int(r["column_name"]): r["m"] for r in found}
    return [by.get(i) for i in range(len(weighted))]


def privacy(real: DataFrame, synthetic: DataFrame, key: str, most_synthetic: int | None = 500, most_real: int | None = 2000, seed: int = 42) -> DataFrame:
    """(exact_match_rate, dcr_synthetic, dcr_real, dcr_ratio, score, risk).

    Samples of fixed size are part of the measure; None in place of a size takes all rows, and
    in place of both, every row of either table is asked for its nearest real row, and the
    medians are those of all distances (``nearest.Index``).
    """
    use = [c for c in common(real, synthetic) if c != key]
    numbers = [f.name for f in real.schema if f.name in use and roles.is_numeric(f.dataType)]
    labels = [f.name for f in real.schema if f.name in use and f.dataType.simpleString() in ("string", "boolean")]
    sample = lambda df, n: df if n is None else df.orderBy(exprs.md5_order(key, seed=seed)).limit(n)
    ranges = real.agg(*(F.max(exprs.number(c)) - F.min(exprs.number(c)) for c in numbers)).toDF(*numbers).first().asDict() if numbers else {}
    if most_synthetic is None and most_real is None:
        index = nearest.Index(real, numbers, labels, ranges, key)
        s, r = medians([index.distances(index.different(index.asked(synthetic, False))), index.distances(index.own())])
        medians_of = real.sparkSession.createDataFrame([(s, r, 1)], "s double, r double, one int")
    else:
        r = sample(real, most_real)
        near = gower_nearest(sample(synthetic, most_synthetic), r, numbers, labels, ranges, key, most=most_real)
        own = gower_nearest(sample(r, most_synthetic), r, numbers, labels, ranges, key, itself=True, most=most_real)
        medians_of = near.agg(F.median("distance").alias("s"), F.lit(1).alias("one")).join(own.agg(F.median("distance").alias("r"), F.lit(1).alias("one")), "one")
    exact = exact_matches(real, synthetic, numbers + labels).withColumn("one", F.lit(1))
    ratio = F.when(F.col("r") > 0, F.col("s") / F.col("r")).otherwise(F.when(F.col("s") > 0, 1.0).otherwise(0.0))
    x = F.col("exact_match_rate")
    score = 50 * (1 - x) + 50 * F.least(F.lit(1.0), ratio)
    risk = F.when((x > 0.05) | (ratio < 0.5), "HIGH").when((x > 0.01) | (ratio < 0.8), "MEDIUM").otherwise("LOW")
    return medians_of.join(exact, "one").select(x, F.round("s", 6).alias("dcr_synthetic"), F.round("r", 6).alias("dcr_real"), F.round(ratio, 4).alias("dcr_ratio"), F.round(score, 4).alias("score"), risk.alias("risk"))


def composite(metrics: DataFrame) -> DataFrame:
    """(overall_score, grade) of metric rows (metric, score); privacy does not count."""
    overall = F.round(F.avg(F.when(F.col("metric") != "privacy", F.col("score"))), 2)
    return metrics.agg(overall.alias("overall_score")).withColumn("grade", grade(F.col("overall_score")))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").when(score.isNotNull(), "poor").otherwise("not_available")
