"""Cleaning: outliers, imputation, derived features, column actions, whole preprocessing.

Statistics come from one small aggregate over the table; rows are then marked or filled by
expressions that hold the statistics as literals, so no row is shuffled.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from weftline.functions import exprs, roles, words
from weftline.functions.storage import settle
from weftline.operators import profile


def iqr_flags(df: DataFrame, columns: list[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    """Add ``{column}_outlier``: outside the quartiles by more than ``factor`` ranges."""
    q = profile.quantiles(df, columns, [0.25, 0.75], exact)
    flags = {}
    for c in columns:
        if c not in q:
            flags[f"{c}_outlier"] = F.lit(False)
            continue
        low, high = q[c]
        span = high - low
        v = exprs.number(c)
        flags[f"{c}_outlier"] = F.coalesce((v < low - factor * span) | (v > high + factor * span), F.lit(False))
    return df.withColumns(flags)


def zscore_flags(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Add ``{column}_outlier``: further than ``limit`` sample deviations from the mean."""
    s = df.agg(*(F.avg(exprs.number(c)).alias(f"m_{c}") for c in columns), *(F.stddev_samp(exprs.number(c)).alias(f"s_{c}") for c in columns)).first()
    flag = lambda c: F.lit(False) if not s[f"s_{c}"] else F.coalesce(F.abs((exprs.number(c) - s[f"m_{c}"]) / s[f"s_{c}"]) > limit, F.lit(False))
    return df.withColumns({f"{c}_outlier": flag(c) for c in columns})


def column_kinds(df: DataFrame, sample: int = 1000) -> dict[str, str]:
    """number, date, boolean or text for every column.

    Dates are columns named like one (numbers aside) and texts of which 80 % read as dates in
    a sample by hash.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not re.search(words.DATE_NAME, f.name)]
    dated = roles.sample_rows(df, sample).select(*(exprs.text_or_null(c).alias(c) for c in texts)).agg(*(F.avg(F.when(F.col(c).isNotNull(), exprs.parse_date(c).isNotNull().cast("int"))).alias(c) for c in texts)).first() if texts else {}
    kinds = {}
    for f in df.schema:
        if roles.is_numeric(f.dataType):
            kinds[f.name] = "number"
        elif isinstance(f.dataType, roles.TEMPORAL) or (isinstance(f.dataType, T.StringType) and (f.name not in texts or (dated[f.name] or 0) >= 0.8)):
            kinds[f.name] = "date"
        else:
            kinds[f.name] = "boolean" if isinstance(f.dataType, T.BooleanType) else "text"
    return kinds


def fill_values(df: DataFrame, exact: bool = True) -> dict[str, tuple[str, object]]:
    """For each column: its kind and what fills it (median, median date, smallest mode), or None if it has no value."""
    kinds = column_kinds(df)
    moment = lambda c: F.unix_timestamp(exprs.parse_date(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("timestamp"))
    ordered = [c for c, k in kinds.items() if k in ("number", "date")]
    measured = df.select(*(F.col(c) if kinds[c] == "number" else moment(c).alias(c) for c in ordered))
    if any(kinds[c] == "date" and dict(df.dtypes)[c] == "string" for c in ordered):
        measured = settle(measured)  # dates are read once, not in every scan for a quantile
    middles = profile.quantiles(measured, ordered, [0.5], exact) if ordered else {}
    fills: dict[str, tuple[str, object]] = {}
    for c, kind in kinds.items():
        value = middles[c][0] if c in middles else None
        if kind == "date" and value is not None:
            value = datetime.fromtimestamp(math.floor(value), tz=timezone.utc).strftime("%Y-%m-%d")
        fills[c] = (kind, value)
    texts = [c for c, k in kinds.items() if k in ("text", "boolean")]
    if texts:
        # the most frequent value of each column, the smallest on a tie: grouped counts, not a map in one task
        long = df.select(*(exprs.text_or_null(c).alias(c) for c in texts)).unpivot([], texts, "c", "v").filter("v is not null")
        counts = long.groupBy("c", "v").agg(F.count("*").alias("n"))
        for r in counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("best")).collect():
            fills[r["c"]] = (kinds[r["c"]], r["best"]["v"])
    return fills


def impute(df: DataFrame, reference: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Fill missing cells with values learnt from ``reference``, or from the table itself.

    A column with no value at all becomes the text "unknown", whatever its type was; where only
    the reference has none, dates become a fixed day, numbers 0 and flags false.
    """
    learnt = fill_values(df if reference is None else reference, exact)
    own = learnt if reference is None else None
    if own is None:
        filled = df.agg(*(F.count(exprs.text_or_null(c)).alias(c) for c in df.columns)).first()
        kinds = column_kinds(df)
    out = {}
    for f in df.schema:
        kind, value = learnt.get(f.name, (None, None))
        if own is not None and value is None or own is None and not filled[f.name]:
            out[f.name] = F.coalesce(exprs.text_or_null(f.name), F.lit(words.UNKNOWN))
            continue
        kind = kind or kinds[f.name]
        if kind == "number" and (roles.is_numeric(f.dataType) or value is not None):
            out[f.name] = F.coalesce(exprs.number(f.name), F.lit(float(value or 0)))
        elif kind == "boolean" and isinstance(f.dataType, T.BooleanType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(value == "true"))
        elif kind == "date":
            text = F.date_format(F.col(f.name), "yyyy-MM-dd") if isinstance(f.dataType, roles.TEMPORAL) else exprs.text_or_null(f.name)
            out[f.name] = F.coalesce(text, F.lit(value or words.DATE_SENTINEL))
        else:
            out[f.name] = F.coalesce(exprs.text_or_null(f.name), F.lit(value if value is not None else words.UNKNOWN))
    return df.select(*(c.alias(n) for n, c in out.items()))


def lead_time(df: DataFrame, start: str, end: str, name: str = "lead_time") -> DataFrame:
    """Whole days between two moments, rounded down."""
    seconds = F.unix_timestamp(exprs.parse_date(end)) - F.unix_timestamp(exprs.parse_date(start))
    return df.withColumn(name, F.floor(seconds / 86400))


def cost_per_unit(df: DataFrame, cost: str, quantity: str, name: str = "cost_per_unit") -> DataFrame:
    return df.withColumn(name, exprs.divide(cost, F.nullif(F.col(quantity), F.lit(0))))


def domain_features(df: DataFrame) -> DataFrame:
    """Add lead_time and cost_per_unit where the columns for them are there."""
    names = {c.lower().replace(" ", "_"): c for c in df.columns}
    if {"order_date", "delivery_date"} <= names.keys():
        df = lead_time(df, names["order_date"], names["delivery_date"])
    if {"total_cost", "quantity"} <= names.keys():
        df = cost_per_unit(df, names["total_cost"], names["quantity"])
    return df


def derived(df: DataFrame, definitions: list[dict]) -> DataFrame:
    """Columns computed by a left fold: {name, operation, columns}; missing operands are an error."""
    for spec in definitions:
        if lost := [c for c in spec["columns"] if c not in df.columns]:
            raise ValueError(f"derived column {spec['name']} needs {lost}")
        df = df.withColumn(spec["name"], exprs.fold(spec["operation"], spec["columns"]))
    return df


def new_ids(df: DataFrame, column: str, order: list[str], prefix: str | None = None, width: int = 6) -> DataFrame:
    """Replace a column by counted ids.

    Row numbers run over ranges of the order and the ranges' sizes, not over one task.
    """
    ranked = numbered(df, order, "_number")
    text = F.concat(F.lit(f"{prefix or column}_"), F.lpad(F.col("_number").cast("string"), width, "0") if width else F.col("_number").cast("string"))
    return ranked.withColumn(column, text).drop("_number")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers by ``order``: sort by range, count each range, add up the counts."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    # settled, for ranges are drawn anew whenever a plan runs again
    ranged = settle(ranged.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("long"), 33)))
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row per task
    bases, total = [], start
    for r in range(max(sizes, default=-1) + 1):
        bases.append(total)
        total += sizes.get(r, 0)
    if not bases:
        return df.withColumn(name, F.lit(None).cast("long"))
    return ranged.withColumn(name, F.element_at(F.array(*map(F.lit, bases)), F.col("_range") + 1).cast("long") + F.col("_place")).drop("_range", "_place")


def apply_actions(df: DataFrame, actions: dict[str, str], order: list[str], derived_columns: list[dict] | None = None) -> DataFrame:
    """Configured actions: new ids, then derived columns, then removals."""
    wanted = {c: roles.normal_action(a) for c, a in actions.items() if c in df.columns}
    for c, a in wanted.items():
        if a == "new_id":
            df = new_ids(df, c, order, "ID", 0)
    df = derived(df, derived_columns or [])
    return df.drop(*(c for c, a in wanted.items() if a == "remove"))


def output_checks(df: DataFrame) -> list:
    """Aggregates: rows, the nulls of each column and the infinities of each number column."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return [F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in df.columns), *(F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"infinite {c}") for c in numbers)]


def told_problems(found: dict, rows: int | None) -> list[str]:
    """What the aggregates of ``output_checks`` find wrong."""
    n = found["_n"]
    return (["no rows"] if not n else []) + ([f"{n} rows, not {rows}"] if rows not in (None, n) else []) + [k for k, v in found.items() if v and k != "_n"]


def output_problems(df: DataFrame, rows: int | None = None) -> list[str]:
    """What keeps a preprocessed table from use: no rows, another number of rows, nulls, infinities."""
    return told_problems(df.agg(*output_checks(df)).first().asDict(), rows)


def outliers(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, iqr, zscore): the outliers of each number column by either rule."""
    numbers = profile.numeric_columns(df)
    if not numbers:
        return df.sparkSession.createDataFrame([], "column_name string, iqr long, zscore long")
    by_iqr, by_score = iqr_flags(df, numbers, exact=exact), zscore_flags(df, numbers)
    count = lambda d, name: d.agg(*(F.count_if(F.col(f"{c}_outlier")).alias(c) for c in numbers)).unpivot([], numbers, "column_name", name)
    return count(by_iqr, "iqr").join(count(by_score, "zscore"), "column_name")


def preprocess(df: DataFrame, actions: dict[str, str] | None = None, order: list[str] | None = None, for_generation: bool = False, validate: bool = True) -> DataFrame:
    """Impute, apply column actions and, unless rows are to be generated from it, add features and encode.

    The result is checked: it has the table's rows, and no null and no infinity but for a cost
    per unit of no units. What ``outliers`` finds in the table as it came is a report of its own.
    """
    from weftline.operators import encode

    out = impute(df)
    if actions:
        out = apply_actions(out, actions, order or df.columns[:1])
    if not for_generation:
        kept = [c for c, a in (actions or {}).items() if roles.normal_action(a) in ("llm", "new_id", "remove")]
        kept += [c for c in out.columns if c.lower().endswith("id")]
        out = domain_features(out)
        out = encode.prepare(out, [c for c in profile.text_columns(out) if c not in kept])
    if validate:
        refuse(output_problems(out, df.count()))
    return out


def refuse(problems: list[str]) -> None:
    if problems := [p for p in problems if p != "null cost_per_unit"]:
        raise ValueError("preprocessing left " + "; ".join(problems))


def preprocess_to(df: DataFrame, path: str, actions: dict[str, str] | None = None, order: list[str] | None = None, for_generation: bool = False) -> int:
    """Write the preprocessed table as Parquet and return its rows; what is wrong with it is counted by the job that writes it.

    A table with faults is not left behind: its folder goes, and the faults are an error.
    """
    out, seen = preprocess(df, actions, order, for_generation, validate=False), Observation()
    out.observe(seen, *output_checks(out)).write.parquet(path)
    found = seen.get
    try:
        refuse(told_problems(found, df.count()))
    except ValueError:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
        raise
    return found["_n"]


def preprocess_run(df: DataFrame, actions: dict[str, str] | None = None, order: list[str] | None = None, for_generation: bool = False) -> dict[str, DataFrame]:
    """The preprocessed table and the outliers of the raw one."""
    return {"table": preprocess(df, actions, order, for_generation), "outliers": outliers(df)}
