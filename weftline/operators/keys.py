"""Primary and foreign keys: integrity, remapping, key functions and new ids.

Keys are compared as distinct sets, pre-aggregated before the join, so a hot foreign key
costs one row.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import exprs, words
from weftline.operators import clean


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """(key, rows): foreign keys that no parent has; null keys are left out."""
    keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key")).agg(F.count("*").alias("rows"))
    return keys.join(parent.select(F.col(pk).alias("key")).distinct(), "key", "left_anti")


def integrity(relations: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """(child, fk, parent, pk, total_rows, valid_rows, score) for (child name, child, fk, parent name, parent, pk).

    A column that is not there scores 0. Without relations the result has no row.
    """
    out = None
    for child_name, child, fk, parent_name, parent, pk in relations:
        names = [F.lit(child_name).alias("child"), F.lit(fk).alias("fk"), F.lit(parent_name).alias("parent"), F.lit(pk).alias("pk")]
        if fk not in child.columns or pk not in parent.columns:
            row = child.agg(F.count("*").alias("total_rows")).select(*names, "total_rows", F.lit(0).cast("long").alias("valid_rows"), F.lit(0.0).alias("score"))
        else:
            keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key")).agg(F.count("*").alias("n"))
            known = parent.select(F.col(pk).alias("key")).distinct().withColumn("hit", F.lit(1))
            sums = keys.join(known, "key", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("valid_rows"))
            score = F.round(F.coalesce(exprs.divide(F.col("valid_rows") * 100, "total_rows"), F.lit(100.0)), 4)
            row = sums.select(*names, "total_rows", "valid_rows", score.alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


def key_report(df: DataFrame, pk: str) -> DataFrame:
    """(total_rows, distinct_keys, null_keys, is_unique)"""
    counts = df.groupBy(F.col(pk).alias("k")).agg(F.count("*").alias("n"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("k").alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"))
    return sums.withColumn("is_unique", F.col("total_rows") == F.col("distinct_keys"))


def foreign_key_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """(total_rows, orphan_rows) where a null foreign key is an orphan."""
    known = parent.select(F.col(pk).alias("key")).distinct().withColumn("hit", F.lit(1))
    keys = child.groupBy(F.col(fk).alias("key")).agg(F.count("*").alias("n"))
    return keys.join(known, "key", "left").agg(F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"))


def remap(parent_original: DataFrame, parent_final: DataFrame, pk: str, order: str, final_order: str) -> DataFrame:
    """(old_key, new_key): the i-th original key goes to the (i mod n)-th final key."""
    old = clean.numbered(parent_original.select(F.col(pk).alias("old_key"), F.col(order).alias("_o")), ["_o"], "i", 0)
    new = clean.numbered(parent_final.select(F.col(pk).alias("new_key"), F.col(final_order).alias("_o")), ["_o"], "j", 0)
    n = parent_final.count()
    if not n:
        raise ValueError("no parent keys to map to")
    return old.withColumn("j", F.pmod("i", F.lit(n))).join(new.select("j", "new_key"), "j").select("old_key", "new_key")


def rewrite_keys(child: DataFrame, fk: str, mapping: DataFrame) -> DataFrame:
    """The child's foreign keys by the mapping; keys that are not in it stay."""
    m = mapping.select(F.col("old_key").alias("_old"), F.col("new_key").alias("_new"))
    return child.join(m, F.col(fk) == F.col("_old"), "left").withColumn(fk, F.coalesce("_new", fk)).drop("_old", "_new")


def key_function(df: DataFrame, key: str, value: str, least: float = 0.95) -> DataFrame:
    """(agreement, is_key_function): whether the last number in a value is that in the key."""
    same = (exprs.last_number(key) == exprs.last_number(value)).cast("int")
    return df.agg(F.round(F.coalesce(F.avg(F.coalesce(same, F.lit(0))), F.lit(0.0)), 6).alias("agreement"), F.count_distinct(key).alias("keys"), F.count(key).alias("filled")).select(
        "agreement", ((F.col("agreement") >= least) & (F.col("keys") == F.col("filled"))).alias("is_key_function")
    )


def apply_key_function(df: DataFrame, key: str, value: str, known: DataFrame, prefix: str, width: int, suffix: str = "") -> DataFrame:
    """A value looked up by key, else the template ``prefix`` + the key's number, zero-padded, + ``suffix``."""
    look = known.select(F.col(key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    number = exprs.last_number(key).cast("string")
    made = F.concat(F.lit(prefix), F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0")), F.lit(suffix))
    return df.join(look, F.col(key) == F.col("_k"), "left").withColumn(value, F.coalesce("_v", made)).drop("_k", "_v")


def id_columns(df: DataFrame) -> list[str]:
    """Columns named like ids that are unique and filled, floats aside."""
    named = [f.name for f in df.schema if re.search(r"(^|_)(id|key|code|uuid)$", f.name.lower()) and f.dataType.simpleString() not in ("float", "double")]
    if not named:
        return []
    row = df.agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in named)).first()
    return [c for c in named if row[c] == row["_n"]]


def id_pattern(values: list[str]) -> dict:
    """How a column's ids are made: uuid, counter, template or free, with what is needed to go on."""
    values = [v for v in values if v]
    if not values:
        return {"kind": "free", "prefix": ""}
    if sum(bool(re.match(words.UUID, v)) for v in values) >= 0.8 * len(values):
        return {"kind": "uuid"}
    runs = [re.findall(r"[A-Z]+|[a-z]+|\d+|[^A-Za-z0-9]+", v) for v in values]
    kind = lambda r: "U" if r.isupper() else "L" if r.islower() else "D" if r.isdigit() else "S"
    shapes: dict[tuple, list] = {}
    for r in runs:
        shapes.setdefault(tuple(map(kind, r)), []).append(r)
    shape, best = max(shapes.items(), key=lambda x: len(x[1]))
    if len(best) < 0.8 * len(values):
        low, high = min(values), max(values)
        n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        return {"kind": "free", "prefix": re.match(r"[A-Za-z]*", low[:n])[0], "length": round(sum(map(len, values)) / len(values))}
    columns = list(zip(*best))
    vary = [i for i, c in enumerate(columns) if len(set(c)) > 1]
    numbers = [int(x) for x in columns[vary[0]]] if len(vary) == 1 and shape[vary[0]] == "D" else []
    if numbers and (numbers == sorted(numbers) or len(set(numbers)) >= 0.9 * (max(numbers) - min(numbers) + 1)):
        digits = columns[vary[0]]
        width = max(map(len, digits)) if any(d.startswith("0") and len(d) > 1 for d in digits) else 0
        i = vary[0]
        return {"kind": "counter", "prefix": "".join(c[0] for c in columns[:i]), "suffix": "".join(c[0] for c in columns[i + 1 :]), "width": width, "start": max(numbers) + 1}
    return {"kind": "template", "runs": [(None if i in vary else c[0], shape[i], max(map(len, c))) for i, c in enumerate(columns)]}


def make_ids(rows: DataFrame, column: str, order: list[str], pattern: dict, existing: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``rows`` with new ids after the pattern; none of ``existing`` (one column) is used again.

    Counters go on behind the largest number. Other kinds are made of hashes of the row's
    number, so retries and reruns agree.
    """
    numbered = clean.numbered(rows, order, "_i", 0)
    if pattern["kind"] == "counter":
        number = (F.col("_i") + pattern["start"]).cast("string")
        padded = F.when(F.length(number) >= pattern["width"], number).otherwise(F.lpad(number, max(1, pattern["width"]), "0"))
        return numbered.withColumn(column, F.concat(F.lit(pattern["prefix"]), padded, F.lit(pattern["suffix"]))).drop("_i")
    alphabet = {"U": string.ascii_uppercase, "L": string.ascii_lowercase, "D": string.digits, "S": "-"}

    def some(letters: str, n: int, salt: str) -> Column:
        """``n`` letters by bytes of hashes of the row's number."""
        blocks = F.concat(*(F.sha2(F.concat_ws(":", F.lit(f"{seed}:{salt}:{k}"), F.col("_i").cast("string")), 256) for k in range(-(-n // 16))))
        code = lambda i: F.conv(F.substring(blocks, 4 * i + 1, 4), 16, 10).cast("int") % len(letters)
        return F.concat(*(F.substring(F.lit(letters), code(i) + 1, F.lit(1)) for i in range(n))) if n else F.lit("")

    def ids(attempt: int) -> Column:
        if pattern["kind"] == "uuid":
            h = F.sha2(F.concat_ws(":", F.lit(f"{seed}:{attempt}"), F.col("_i").cast("string")), 256)
            part = lambda at, n: F.substring(h, at, n)
            return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
        if pattern["kind"] == "template":
            return F.concat(*(F.lit(fixed) if fixed is not None else some(alphabet[k], n + attempt // 2, f"{attempt}:{at}") for at, (fixed, k, n) in enumerate(pattern["runs"])))
        size = max(6, pattern.get("length", 8) - len(pattern["prefix"])) + attempt
        return F.concat(F.lit(pattern["prefix"]), some(string.ascii_uppercase + string.digits, size, str(attempt)))

    out = numbered.withColumn(column, ids(0))
    for attempt in range(1, 7):
        taken = out.groupBy(F.col(column).alias("_v")).agg(F.min("_i").alias("_first"))
        marked = out.join(taken, F.col(column) == F.col("_v")).withColumn("_again", F.col("_i") != F.col("_first")).drop("_v", "_first")
        if existing is not None:
            old = existing.toDF("_e").distinct().withColumn("_old", F.lit(True))
            marked = marked.join(old, F.col(column) == F.col("_e"), "left").withColumn("_again", F.col("_again") | F.coalesce("_old", F.lit(False))).drop("_e", "_old")
        if marked.filter("_again").isEmpty():
            return out.drop("_i")
        out = marked.withColumn(column, F.when(F.col("_again"), ids(attempt)).otherwise(F.col(column))).drop("_again")
    raise RuntimeError(f"{column}: no free ids after 6 widenings")


def next_integers(df: DataFrame, column: str) -> dict:
    """Where an integer id column goes on: behind its maximum if it rises or is dense, else at random within its range."""
    row = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count_distinct(column).alias("n")).first()
    dense = row["low"] is not None and row["n"] >= 0.9 * (row["high"] - row["low"] + 1)
    return {"kind": "counter" if dense else "random", "start": (row["high"] or 0) + 1, "low": row["low"], "high": row["high"]}
