"""Helpers that every corpus operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.storage import settle as persist  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, UPPER, LOWER)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the rising ``bounds`` are not above the value, found by halving steps."""
    if not bounds:
        return F.lit(0)
    known, steps = F.array(*map(F.lit, bounds)), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    fits = lambda i: (i <= len(bounds)) & (F.element_at(known, F.least(i, F.lit(len(bounds)))) <= value)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when(fits(i + s), i + s).otherwise(i))
