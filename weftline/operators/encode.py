"""Categorical encodings and the choice among them."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import words
from weftline.operators import clean, profile

MAX_CATEGORIES, HASH_FEATURES = 30, 16


def category(c: str) -> Column:
    """The value as text; nulls are a category of their own."""
    return F.coalesce(F.col(c).cast("string"), F.lit(words.MISSING_CATEGORY))


def categories(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """The sorted categories of a column; more than ``limit`` is an error, for they become columns or literals."""
    rows = df.select(category(column).alias("v")).distinct().orderBy("v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has over {limit} categories")
    return [r["v"] for r in rows]


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """Add {column}_{value} with 0 and 1 for each category."""
    return df.withColumns({f"{column}_{v}": (category(column) == v).cast("int") for v in categories(df, column)})


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): categories numbered in order, over ranges of the values and the ranges' sizes."""
    return clean.numbered(df.select(category(column).alias("value")).distinct(), ["value"], "code", 0)


def binary(df: DataFrame, column: str) -> DataFrame:
    """Add {column}_bin_{i}: the bits of the category's number."""
    numbered = codes(df, column)
    n = numbered.count()
    bits = max(1, math.ceil(math.log2(max(2, n))))
    joined = df.withColumn("_v", category(column)).join(numbered, F.col("_v") == F.col("value"), "left")
    return joined.withColumns({f"{column}_bin_{b}": F.shiftright("code", b).bitwiseAND(F.lit(1)) for b in range(bits)}).drop("_v", "value", "code")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Add {column}_count and {column}_frequency; counts come by a join, which a hot value does not pile up."""
    counts = df.groupBy(category(column).alias("_value")).agg(F.count("*").alias(f"{column}_count"))
    joined = df.withColumn("_v", category(column)).join(counts, F.col("_v") == F.col("_value"), "left").drop("_v", "_value")
    total = df.count()
    return joined.withColumn(f"{column}_frequency", F.col(f"{column}_count") / F.lit(float(max(1, total))))


def md5_bucket(c: Column, features: int) -> Column:
    """A portable hash bucket: the first 8 hex digits of an md5, modulo ``features``."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(features)).cast("int")


def blake_bucket(c: Column, features: int) -> Column:
    """The hash bucket by BLAKE2b with 8 bytes, for results that must agree with it."""

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return values.map(lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") % features)

    return bucket(c)


def hashed(df: DataFrame, column: str, features: int = HASH_FEATURES, portable: bool = True) -> DataFrame:
    """Add {column}_hash_{i}: 1 in the value's bucket."""
    bucket = (md5_bucket if portable else blake_bucket)(category(column), features)
    return df.withColumn("_bucket", bucket).withColumns({f"{column}_hash_{i}": (F.col("_bucket") == i).cast("int") for i in range(features)}).drop("_bucket")


def scores(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES, features: int = HASH_FEATURES) -> DataFrame:
    """(column_name, method, score, output_dimensions): the cost of each encoding, lower is better."""
    long = df.select(*(category(c).alias(c) for c in columns)).unpivot([], columns, "column_name", "value")
    sizes = long.groupBy("column_name", "value").agg(F.count("*").alias("n")).groupBy("column_name", "n").agg(F.count("*").alias("same"))
    k = sizes.groupBy("column_name").agg(F.sum("same").cast("double").alias("k"), F.coalesce(F.sum(F.when(F.col("same") > 1, F.col("same"))), F.lit(0)).alias("shared"))
    cap = float(max(1, max_categories))
    of = lambda dims: F.least(F.lit(1.0), dims / cap)
    bits = F.greatest(F.lit(1.0), F.ceil(F.log2(F.greatest(F.lit(2.0), F.col("k")))).cast("double"))
    loss = F.least(F.lit(1.0), F.col("shared") / F.greatest(F.lit(1.0), F.col("k")))
    width = float(max(2, min(features, 256)))
    clash = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("k") * (F.col("k") - 1) / (2 * width)) / F.greatest(F.lit(1.0), F.col("k")))
    raw = {
        "onehot": (F.lit(0.05) + 0.40 * of(F.greatest(F.lit(1.0), F.col("k"))), F.greatest(F.lit(1.0), F.col("k"))),
        "binary": (F.lit(0.18) + 0.04 * of(bits), bits),
        "frequency": (F.lit(0.18) + 0.35 * loss, F.lit(1.0)),
        "count": (F.lit(0.20) + 0.35 * loss, F.lit(1.0)),
        "hashing": (F.lit(0.22) + 0.30 * clash + 0.03 * of(F.lit(width)), F.lit(width)),
    }
    options = F.array(*(F.struct(F.lit(m).alias("method"), F.round(s, 4).alias("score"), dims.alias("output_dimensions")) for m, (s, dims) in raw.items()))
    return k.select("column_name", F.inline(options))


def skips(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Columns not to encode: constants, identifiers and long texts."""
    lengths = df.agg(F.count("*").alias("_n"), *(F.approx_count_distinct(c, 0.01).alias(f"u_{c}") for c in columns), *(F.percentile_approx(F.length(F.col(c).cast("string")), 0.5).alias(f"l_{c}") for c in columns)).first()
    out = {}
    for c in columns:
        name, n, u = c.strip().lower(), lengths["_n"], lengths[f"u_{c}"]
        if u <= 1:
            out[c] = "skip_constant"
        elif name in words.ENCODER_ID_NAMES or name.endswith(("_id", " id", "_uuid", "_key")) or (n >= 20 and u / max(1, n) >= 0.98):
            out[c] = "skip_identifier"
        elif (lengths[f"l_{c}"] or 0) >= 80:
            out[c] = "skip_text"
    return out


def choose(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The cheapest encoding of each column, or why it is skipped."""
    columns = columns or profile.text_columns(df)
    if not columns:
        return {}
    out = skips(df, columns)
    left = [c for c in columns if c not in out]
    if left:
        best = scores(df, left).groupBy("column_name").agg(F.min(F.struct("score", "method")).alias("best"))
        out |= {r["column_name"]: r["best"]["method"] for r in best.collect()}
    return out


def prepare(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Encode every text column by the chosen method and drop it; skipped columns stay."""
    encoders = {"onehot": one_hot, "binary": binary, "hashing": hashed}
    for c, method in choose(df, columns).items():
        if method in encoders:
            df = encoders[method](df, c).drop(c)
        elif method in ("frequency", "count"):
            drop = f"{c}_count" if method == "frequency" else f"{c}_frequency"
            df = frequency(df, c).drop(drop, c)
    return df
