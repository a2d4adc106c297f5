"""Schemas and table shapes: what to train on, how results are brought back into form, what a table holds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from weftline.functions import exprs, roles
from weftline.operators import clean, compare, keys, profile, repair, rules


def model_columns(df: DataFrame, actions: dict[str, str]) -> DataFrame:
    """The columns a table generator learns: without those to remove or to be written as text."""
    return df.drop(*(c for c, a in actions.items() if roles.normal_action(a) in ("remove", "llm")))


def training_frame(df: DataFrame, ids: list[str], foreign: list[str], derived: list[str], functions: list[str]) -> DataFrame:
    """Without ids, foreign keys, derived columns and key functions; the whole table if nothing is left."""
    left = [c for c in df.columns if c not in {*ids, *foreign, *derived, *functions}]
    return df.select(*left) if left else df


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; those that are not there are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns))


def few_valued_as_text(df: DataFrame, low: int = 2, high: int = 15) -> DataFrame:
    """Number columns of ``low`` to ``high`` values become text."""
    numbers = profile.numeric_columns(df)
    if not numbers:
        return df
    counts = df.agg(*(F.approx_count_distinct(c, 0.01).alias(c) for c in numbers)).first()
    return df.withColumns({c: F.col(c).cast("string") for c in numbers if low <= counts[c] <= high})


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """Numbers in the types and decimal places of ``like``."""
    floats = [f.name for f in like.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and f.name in df.columns]
    places = repair.rounding(like, floats) if floats else {}
    out = {}
    for f in like.schema:
        if f.name not in df.columns:
            continue
        if f.name in places:
            out[f.name] = F.round(exprs.number(f.name), places[f.name]).cast(f.dataType)
        elif roles.is_numeric(f.dataType):
            out[f.name] = F.round(exprs.number(f.name)).cast(f.dataType)
    return df.withColumns(out)


def synthetic_problems(df: DataFrame, like: DataFrame, rows: int, ids: list[str] = ()) -> list[str]:
    """What is wrong with a generated table: row count, columns and their order, number types, repeated ids."""
    found = []
    if (n := df.count()) != rows:
        found.append(f"{n} rows, not {rows}")
    if df.columns != like.columns:
        found.append("columns differ")
    found += [f"{f.name} is not a number" for f in like.schema if roles.is_numeric(f.dataType) and f.name in df.columns and not roles.is_numeric(df.schema[f.name].dataType)]
    return found + [f"{c} repeats" for c in ids if not keys.key_report(df, c).first()["is_unique"]]


def is_ascending(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(rows, ascending): whether a number never falls in the given order.

    Ranges of the order are checked for themselves and at their borders.
    """
    placed = clean.numbered(df.select(*order, exprs.number(column).alias("_v")), order, "_n").withColumn("_part", F.floor(F.col("_n") / 100_000))
    step = F.col("_v") < F.lag("_v").over(Window.partitionBy("_part").orderBy("_n"))
    parts = placed.withColumn("_falls", F.coalesce(step, F.lit(False))).groupBy("_part").agg(F.count("*").alias("n"), F.max("_falls").alias("falls"), F.min_by("_v", "_n").alias("first"), F.max_by("_v", "_n").alias("last"))
    border = F.coalesce(F.col("first") < F.lag("last").over(Window.orderBy("_part")), F.lit(False))  # one row per 100,000
    return parts.withColumn("border", border).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (~F.coalesce(F.max(F.col("falls") | F.col("border")), F.lit(False))).alias("ascending"))


def correlated_pairs(df: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """(column_a, column_b, correlation) of pairs that correlate, either way."""
    return compare.correlation_long(df, columns).filter(F.abs("correlation") >= least)


def p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of a two-sample KS distance."""
    if not n or not m:
        return 1.0
    x = d * math.sqrt(n * m / (n + m))
    return 1.0 if x < 0.2 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def divergent_column(df: DataFrame, labels: list[str], numbers: list[str], least_rows: int = 40, distance: float = 0.25, share: float = 0.35) -> str | None:
    """The first label whose two largest groups differ in the distribution of enough number columns."""
    for c in labels:
        top = df.groupBy(c).agg(F.count("*").alias("n")).filter(F.col(c).isNotNull()).orderBy(F.desc("n"), c).limit(2).collect()
        if len(top) < 2 or top[1]["n"] < least_rows:
            continue
        a, b = (df.filter(F.col(c) == r[c]) for r in top)
        gaps = compare.ks(a, b, numbers).collect()
        far = sum(r["ks_statistic"] > distance and p_value(r["ks_statistic"], top[0]["n"], top[1]["n"]) < 0.01 for r in gaps)
        if numbers and far / len(numbers) >= share:
            return c
    return None


def analyse_table(df: DataFrame, foreign: list[str] = (), key: str | None = None) -> dict:
    """Ids, key functions (of ``key`` or the first id), derived columns and decimal places of one of several linked tables."""
    ids = keys.id_columns(df)
    key = key or (ids[0] if ids else None)
    texts = [c for c in profile.text_columns(df) if c not in ids and c not in foreign and c != key]
    functions = [c for c in texts if key and keys.key_function(df, key, c).first()["is_key_function"]]
    numbers = [c for c in profile.numeric_columns(df) if c not in ids and c not in foreign and c != key]
    dates = [f.name for f in df.schema if isinstance(f.dataType, roles.TEMPORAL)] + [c for c, k in clean.column_kinds(df.select(*(x for x in texts if x not in functions))).items() if k == "date"]
    derived = rules.detect_derived(df, numbers, dates=dates) if len(numbers) >= 3 or len(dates) >= 2 else []
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return {"ids": ids, "foreign": list(foreign), "functions": functions, "derived": derived, "decimals": repair.rounding(df, floats) if floats else {}}


def preprocessing_summary(before: DataFrame, after: DataFrame, actions: dict[str, str] | None = None) -> dict:
    """Rows, missing cells, outliers, columns put in and taken out, and how often each action is configured."""
    numbers = profile.numeric_columns(before)
    n = before.count()
    flagged = clean.iqr_flags(before, numbers) if numbers else before
    hits = flagged.agg(*(F.count_if(F.col(f"{c}_outlier")).alias(c) for c in numbers)).first().asDict() if numbers else {}
    missing = {r["column_name"]: r["missing_count"] for r in profile.missing_summary(before).collect()}
    counts: dict[str, int] = {}
    for a in (actions or {}).values():
        counts[roles.normal_action(a)] = counts.get(roles.normal_action(a), 0) + 1
    return {
        "rows": n, "missing_filled": {c: v for c, v in missing.items() if v and c in after.columns}, "outlier_percentage": {c: round(100 * v / max(1, n), 2) for c, v in hits.items() if v},
        "added": [c for c in after.columns if c not in before.columns], "removed": [c for c in before.columns if c not in after.columns], "actions": counts,
    }
