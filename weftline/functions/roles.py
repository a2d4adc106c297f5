"""What a column is: identifier, free text, date, number or category.

Decisions need a few dozen values and some ratios; those come from one bounded sample and
one aggregate per table, and the ladder itself runs on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import words

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def sample_rows(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` different rows, those of the smallest hashes of what they hold.

    Neither the order of files and tasks nor how often a row is repeated matters. A sketch of
    the number of different rows gives a hash below which there are enough of them, so only
    those are grouped.
    """
    plain = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType, *NUMERIC, *TEMPORAL))]
    if not plain:
        return df.limit(rows)
    # float zeros of either sign and hashes are no issue for a sample; the hash is read as a share of its range
    hashed = df.select(F.struct(*df.columns).alias("row"), F.xxhash64(*plain).alias("hash"))
    different = hashed.agg(F.approx_count_distinct("hash")).first()[0]
    if different > 8 * rows:
        hashed = hashed.filter(F.col("hash") < int(-(2**63) + 2**64 * min(1.0, 4 * rows / different)))
    return hashed.groupBy("hash").agg(F.any_value("row").alias("row")).orderBy("hash").limit(rows).select("row.*")


def sample_values(df: DataFrame, rows: int = 100) -> dict[str, list]:
    """The values of each column that are not null, as text, from a sample of ``rows`` rows."""
    taken = sample_rows(df, rows).collect()
    return {c: [str(r[c]) for r in taken if r[c] is not None] for c in df.columns}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def role_of(name: str, kind: T.DataType, sample: list[str], config: dict | None = None, profile: dict | None = None) -> str:
    """The role of a column: configuration first, then its profile, then name and contents."""
    config, profile = config or {}, profile or {}
    action, declared = str(config.get("action", "")).lower(), str(config.get("column_type", "")).lower()
    if config.get("is_identifier") or action == "new_id" or declared in ("id", "identifier"):
        return "identifier"
    if action in ("llm", "text") or declared in ("text", "free_form_text"):
        return "free_form_text"
    if declared in ("date", "datetime", "timestamp"):
        return "datetime"
    if profile.get("classification") in ("identifier", "free_form_text", "datetime"):
        return profile["classification"]
    if "uuid" in profile.get("patterns", ()):
        return "identifier"
    low = name.strip().lower()
    tokens = set(re.split(r"[^a-z0-9]+", low))
    head = [v.strip() for v in sample[:30]]
    share = lambda p, values: sum(bool(re.match(p, v)) for v in values) / len(values) if values else 0.0
    textual = isinstance(kind, T.StringType)
    if low in words.IDENTIFIER_NAMES or low.endswith(words.IDENTIFIER_ENDS) or low.startswith(words.IDENTIFIER_STARTS) or (head and share(words.HEX_TOKEN, head) >= 0.8):
        return "identifier"
    if textual and (tokens & set(words.TEXT_NAMES) or long_texts(head)):
        return "free_form_text"
    if isinstance(kind, TEMPORAL) or low in words.DATETIME_NAMES or any(t in low for t in words.DATETIME_PARTS):
        return "datetime"
    if textual and share(words.DATE_LIKE, head[:20]) >= 0.5:
        return "datetime"
    if is_numeric(kind):
        return "numerical"
    return "categorical" if isinstance(kind, (T.StringType, T.BooleanType)) else "unsupported"


def long_texts(values: list[str]) -> bool:
    if not values:
        return False
    n = len(values)
    long_or_wordy = sum(map(len, values)) / n > 35 or sum(len(v.split()) for v in values) / n > 4
    return long_or_wordy and len(set(values)) / n > 0.4


def roles(df: DataFrame, configs: dict[str, dict] | None = None) -> dict[str, str]:
    sample = sample_values(df)
    return {f.name: role_of(f.name, f.dataType, sample[f.name], (configs or {}).get(f.name)) for f in df.schema}


def business_roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns by business concept: identifiers, dates, inventory levels, quantities, prices, statuses, categories, other numbers."""
    out: dict[str, list[str]] = {k: [] for k in ("identifiers", "quantities", "prices", "dates", "statuses", "categories", "inventory_levels", "other_numerics")}
    if not df.columns or df.isEmpty():
        return out
    sample = sample_values(df, 50)
    distinct = df.agg(F.count("*").alias("_n"), *(F.approx_count_distinct(c).alias(c) for c in df.columns)).first()
    has = lambda name, terms: any(t in name for t in terms)
    for field in df.schema:
        name, values = field.name.lower().strip(), sample[field.name]
        dated = bool(values) and isinstance(field.dataType, T.StringType) and all(re.match(words.DATE_LIKE, v.strip()) for v in values[:10])
        mixed = bool(values) and any(c.isdigit() for c in values[0]) and any(c.isalpha() for c in values[0])
        if isinstance(field.dataType, TEMPORAL) or dated:
            out["dates"].append(field.name)
        elif name.endswith(words.REFERENCE_ENDS) or (isinstance(field.dataType, T.StringType) and distinct[field.name] > max(0.8 * distinct["_n"], 20) and mixed):
            out["identifiers"].append(field.name)
        elif is_numeric(field.dataType):
            whole = isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (values and sum(float(v).is_integer() for v in values) / len(values) > 0.95)
            if has(name, words.INVENTORY_TERMS):
                out["inventory_levels"].append(field.name)
            elif has(name, words.QUANTITY_TERMS) or (whole and not has(name, ("price", "cost", "amount"))):
                out["quantities"].append(field.name)
            else:
                out["prices" if has(name, words.PRICE_TERMS) else "other_numerics"].append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            if has(name, words.STATUS_TERMS):
                out["statuses"].append(field.name)
            elif distinct[field.name] <= 50:
                out["categories"].append(field.name)
    return out


ACTIONS = ("keep", "remove", "new_id", "llm", "derived")
ALIASES = {"generalize": "keep", "drop": "remove", "delete": "remove", "text": "llm", "": "keep"}


def normal_action(action: str | None) -> str:
    """The action's canonical name; aliases are resolved, unknown ones are an error."""
    name = (action or "").strip().lower()
    name = ALIASES.get(name, name)
    if name not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    return name
