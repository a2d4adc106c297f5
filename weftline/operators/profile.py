"""Column profiles, one row per column or value.

Wide tables are unpivoted and grouped by column name, so one pass with map-side partial
aggregation serves all columns. ``exact=False`` swaps exact distinct counts and
percentiles for sketches of fixed size, which is what very large tables need.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from weftline.functions import exprs, roles, words
from weftline.functions.storage import settle


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if roles.is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def numeric_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value) of finite doubles or null."""
    columns = columns or numeric_columns(df)
    return df.select(*(exprs.number(c).alias(c) for c in columns)).unpivot([], columns, "column_name", "value")


def text_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or text_columns(df)
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column_name", "value")


def basic(df: DataFrame) -> DataFrame:
    """row_count and column_count."""
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    return {"numeric_columns": numeric_columns(df), "categorical_columns": [c for c in df.columns if c not in numeric_columns(df)]}


def value_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): how often each finite value stands in a number column."""
    return numeric_long(df, columns).filter("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))


#: Distinct values of a column in one slice of its range, about, and slices of a column at most (whose bounds are one row a column).
SLICE_VALUES, MOST_SLICES = 100_000, 4096


def sliced(counts: DataFrame, weights: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``slice``, sums): settled value counts in slices of each column's range.

    Sums have one row per column and slice: ``t_w`` of the slice, ``b_w`` of those before it and
    ``all_w`` of the column, for each weight w.
    """
    most = counts.groupBy("column_name").count().agg(F.max("count")).first()[0] or 0
    slices = min(MOST_SLICES, -(-most // SLICE_VALUES))
    if slices > 1:
        bounds = counts.groupBy("column_name").agg(F.percentile_approx("value", [i / slices for i in range(1, slices)], max(1000, 10 * slices)).alias("cuts"))
        cut = counts.join(F.broadcast(bounds), "column_name").withColumn("slice", exprs.position("value", "cuts", slices)).drop("cuts")  # one row per column
    else:
        cut = counts.withColumn("slice", F.lit(0))
    totals = cut.groupBy("column_name", "slice").agg(*(F.sum(w).alias(f"t_{w}") for w in weights))
    earlier, whole = Window.partitionBy("column_name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("column_name")
    return cut, totals.select("column_name", "slice", *(c for w in weights for c in (f"t_{w}", F.coalesce(F.sum(f"t_{w}").over(earlier), F.lit(0)).alias(f"b_{w}"), F.sum(f"t_{w}").over(whole).alias(f"all_{w}"))))


def within_slices(rows: DataFrame, weights: list[str]) -> DataFrame:
    """Add ``before_w`` to rows that carry their slice's ``b_w``."""
    inside = Window.partitionBy("column_name", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"before_{w}": F.col(f"b_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})


def cumulative(counts: DataFrame, weights: list[str]) -> DataFrame:
    """Add, for each weight column w, ``before_w`` (the sum over smaller values) and ``all_w``.

    Sums run in two steps, within slices of a column's value range and over its slices, so
    no task holds all values of a column.
    """
    cut, sums = sliced(settle(counts), weights)
    joined = cut.join(sums, ["column_name", "slice"])
    return within_slices(joined, weights).drop("slice", *(f"{p}_{w}" for p in "bt" for w in weights))


#: Accuracy of the sketches that bracket exact quantiles: a rank's error is below a share of 1 / ACCURACY.
ACCURACY = 10_000


def bracketed(numbers: DataFrame, columns: list[str], points: list[float], slack: float) -> dict[tuple[str, int], float | None] | None:
    """(column, place of the point) -> quantile; None if a bracket of ``slack`` around a point missed it.

    A sketch gives two values around each point; the rows below the lower one are counted, and
    only the values between them are grouped and ranked.
    """
    probes = [min(1.0, max(0.0, p + d)) for p in points for d in (-slack, slack)]
    row = numbers.agg(*(F.percentile_approx(c, probes, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)), *(x.alias(f"{k}{i}") for i, c in enumerate(columns) for k, x in (("n", F.count(c)), ("l", F.min(c)), ("h", F.max(c))))).first()
    ends = {}
    for i, c in enumerate(columns):
        for k, p in enumerate(points if row[f"n{i}"] else []):
            ends[c, k] = (row[f"l{i}"] if p <= slack else row[f"q{i}"][2 * k], row[f"h{i}"] if p >= 1 - slack else row[f"q{i}"][2 * k + 1], p * (row[f"n{i}"] - 1))
    if not ends:
        return {}
    keys = list(ends)
    below = numbers.agg(*(F.count_if(F.col(c) < ends[c, k][0]).alias(f"b{i}") for i, (c, k) in enumerate(keys))).first()
    arrays = []
    for c in dict.fromkeys(c for c, _ in keys):
        own = [(i, k) for i, (o, k) in enumerate(keys) if o == c]
        arrays += [F.lit(c), F.array(*(F.struct(F.lit(i).alias("i"), F.lit(ends[c, k][0]).alias("low"), F.lit(ends[c, k][1]).alias("high")) for i, k in own))]
    long = numbers.unpivot([], columns, "column_name", "value").filter("value is not null")
    inside = F.filter(F.create_map(*arrays)[F.col("column_name")], lambda x: (F.col("value") >= x["low"]) & (F.col("value") <= x["high"]))
    counts = long.select(F.explode(inside).alias("x"), "value").groupBy("x.i", "value").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.create_map(*(F.lit(x) for i, key in enumerate(keys) for x in (i, float(ends[key][2]) - below[f"b{i}"])))[F.col("i")]
    held = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), F.col("value")))
    found = counts.withColumns({"before": before, "rank": rank}).groupBy("i").agg(held(F.floor("rank")).alias("a"), held(F.ceil("rank")).alias("b")).collect()
    out: dict[tuple[str, int], float | None] = {}
    for r in found:
        c, k = keys[r["i"]]
        if r["a"] is None or r["b"] is None:
            return None
        pos = ends[c, k][2]
        out[c, k] = r["a"] + (pos - math.floor(pos)) * (r["b"] - r["a"])
    return out if len(out) == len(keys) else None


def quantiles(df: DataFrame, columns: list[str], points: list[float], exact: bool = True) -> dict[str, list[float]]:
    """The quantiles of each column that has values, with linear interpolation; no table of values is shuffled."""
    if not columns:
        return {}
    numbers, slack, found = df.select(*(exprs.number(c).alias(c) for c in columns)), 2 / ACCURACY, None
    if not exact:
        row = numbers.agg(*(F.percentile_approx(c, points, ACCURACY).alias(c) for c in columns)).first()
        return {c: list(row[c]) for c in columns if row[c] is not None}
    while found is None:  # a sketch keeps its promise, so the first brackets do
        found = bracketed(numbers, columns, points, slack)
        slack *= 16
    return {c: [found[c, k] for k in range(len(points))] for c in columns if (c, 0) in found}


def numeric(df: DataFrame, columns: list[str] | None = None, exact: bool = True, digits: int = 4) -> DataFrame:
    """Counts, distinct values, moments and quartiles of each numeric column.

    Moments and null counts combine on the map side. Exact distinct counts come from value
    counts, exact quartiles from ``quantiles``; with ``exact=False``, both from sketches.
    """
    long, points = numeric_long(df, columns), [0.25, 0.5, 0.75]
    sketch = [] if exact else [F.approx_count_distinct("value").alias("distinct_count"), F.percentile_approx("value", points, 10_000).alias("q")]
    stats = long.groupBy("column_name").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), *sketch
    )
    if exact:
        names = columns or numeric_columns(df)
        distinct = value_table(df, names).groupBy("column_name").agg(F.count("*").alias("distinct_count"))
        middles = df.sparkSession.createDataFrame([(c, *q) for c, q in quantiles(df, names, points).items()], "column_name string, q0 double, q1 double, q2 double")
        stats = stats.join(distinct, "column_name", "left").join(middles, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    else:
        stats = stats.withColumns({f"q{i}": F.col("q")[i] for i in range(3)})
    rounded = lambda c, name: F.round(c, digits).alias(name)
    return stats.select(
        "column_name", "row_count", "null_count", "distinct_count", rounded("min_value", "min_value"), rounded("q0", "q1"), rounded("q1", "median_value"),
        rounded("q2", "q3"), rounded("max_value", "max_value"), rounded("mean_value", "mean_value"), rounded("std_value", "std_value"),
    )


def string_lengths(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct values, their share and the lengths of each text column."""
    distinct = F.count_distinct("value") if exact else F.approx_count_distinct("value")
    stats = text_long(df, columns).groupBy("column_name").agg(
        F.count("value").alias("filled"), distinct.alias("distinct_count"), F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.round(F.avg(F.length("value")), 4).alias("avg_length"), F.count("*").alias("n"),
    )
    return stats.withColumn("unique_ratio", F.round(exprs.divide("distinct_count", "n"), 4)).drop("n")


def missing_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing cells of each column: count and percentage."""
    columns = columns or df.columns
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(exprs.missing(c)).alias(c) for c in columns))
    long = counts.unpivot(["n"], columns, "column_name", "missing_count")
    return long.select("column_name", "missing_count", F.round(F.coalesce(exprs.divide(F.col("missing_count") * 100, "n"), F.lit(0.0)), 2).alias("missing_percentage"))


def value_counts(df: DataFrame, columns: list[str] | None = None, top: int = 20) -> DataFrame:
    """The ``top`` values of each column, null included, by falling count, then by value."""
    counts = text_long(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("value_count"))
    order = Window.partitionBy("column_name").orderBy(F.desc("value_count"), F.col("value").asc_nulls_last())
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def patterns(df: DataFrame, columns: list[str] | None = None, rows: int = 100, share: float = 0.8) -> DataFrame:
    """Whether each text column's sample reads as e-mail addresses, phone numbers or UUIDs; the sample, of different rows in the order of their hashes, is the feature."""
    columns = columns or text_columns(df)
    sample = text_long(roles.sample_rows(df.select(*columns), rows), columns)
    checks = {"email": words.EMAIL, "phone": words.PHONE, "uuid": words.UUID}
    return sample.groupBy("column_name").agg(*(F.coalesce(F.avg(F.col("value").rlike(p).cast("int")) >= share, F.lit(False)).alias(k) for k, p in checks.items()))


def classifier_input(df: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, dtype, unique_count, unique_ratio, null_ratio, avg_length for the column classifier."""
    kinds = F.create_map(*(F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())))
    distinct = F.count_distinct("value") if exact else F.approx_count_distinct("value")
    long = text_long(df, df.columns).groupBy("column_name").agg(F.count("*").alias("n"), F.count("value").alias("filled"), distinct.alias("unique_count"), F.avg(F.length("value")).alias("avg_length"))
    return long.select(
        "column_name", kinds[F.col("column_name")].alias("dtype"), "unique_count", exprs.divide("unique_count", "n").alias("unique_ratio"),
        exprs.divide(F.col("n") - F.col("filled"), "n").alias("null_ratio"), F.coalesce("avg_length", F.lit(0.0)).alias("avg_length"),
    )


def classify_columns(profile: DataFrame) -> DataFrame:
    """column_name, action and is_identifier by the rules for obvious columns, then by the fallback."""
    name = F.lower(F.trim("column_name"))
    label_name = F.replace(name, F.lit(" "), F.lit("_"))
    any_in = lambda c, terms: F.greatest(*(F.contains(c, F.lit(t)) for t in terms))
    string = F.col("dtype").isin("string", "varchar")
    low_variety = (F.col("unique_count") > 0) & (F.col("unique_count") <= 20) & (F.col("avg_length") <= 24)
    label = any_in(label_name, words.CLASSIFIER_LABEL_HINTS) | (F.col("dtype") == "boolean") | low_variety
    sparse = (F.col("null_ratio") >= 0.5) & (F.col("unique_count") <= 3)
    narrow = (F.col("unique_count") <= 2) & (F.col("avg_length") < 40)
    wordy = any_in(name, words.CLASSIFIER_TEXT_HINTS) | (F.col("avg_length") >= 15) | ((F.col("avg_length") >= 8) & (F.col("unique_ratio") >= 0.3))
    prose = string & ~sparse & ~narrow & ~label & wordy
    id_name = name.isin(*words.CLASSIFIER_ID_NAMES) | name.rlike(r"(_id| id|_key| key)$")
    code_like = (F.col("unique_ratio") > 0.85) & (string | F.col("dtype").isin("int", "bigint")) & any_in(name, ("id", "code", "num"))
    action = (
        F.when(name.startswith("unnamed") | name.isin("index", "level_0", "level_1", ""), "remove")
        .when(F.col("null_ratio") > 0.95, "remove")
        .when((F.col("unique_count") <= 1) & (F.col("null_ratio") < 1), "remove")
        .when(name.rlike(r"^f\d+$"), "keep")
        .when(id_name, "new_id")
        .when(prose, "llm")
        .when(code_like, "new_id")
        .otherwise("keep")
    )
    return profile.select("column_name", action.alias("action")).withColumn("is_identifier", F.col("action") == "new_id")


def full_profile(df: DataFrame, exact: bool = True, top: int = 10, samples: int = 10) -> DataFrame:
    """One row per column: kind, counts, ratios, numeric statistics, lengths, top values and samples as JSON."""
    long = text_long(df, df.columns)
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.col("value").asc_nulls_last())
    best = counts.filter("value is not null").withColumn("p", F.row_number().over(order)).filter(F.col("p") <= max(top, samples))
    tops = best.groupBy("column_name").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("p") <= top, F.struct("value", "n")))))).alias("top_values"),
        F.to_json(F.slice(F.sort_array(F.collect_list("value")), 1, samples)).alias("sample_values"),
    )
    kinds = F.create_map(*(F.lit(x) for f in df.schema for x in (f.name, "numerical" if roles.is_numeric(f.dataType) else "categorical" if f.name in text_columns(df) else "datetime" if isinstance(f.dataType, roles.TEMPORAL) else "other")))
    base = classifier_input(df, exact).withColumn("kind", kinds[F.col("column_name")])
    stats = numeric(df, exact=exact).drop("row_count", "null_count", "distinct_count") if numeric_columns(df) else None
    lengths = string_lengths(df, exact=exact).drop("filled", "distinct_count", "unique_ratio", "avg_length") if text_columns(df) else None
    out = base.join(tops, "column_name", "left")
    for part in (stats, lengths):
        out = out if part is None else out.join(part, "column_name", "left")
    return out
