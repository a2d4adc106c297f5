"""Row validation and the discovery of arithmetic, date and range rules.

Rules become Boolean columns. Arithmetic rules are counted for all column triples at once
(``arithmetic``); date rules take one aggregate over all pairs.
"""

from __future__ import annotations

import warnings
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import exprs, words
from weftline.operators import arithmetic, profile

def violation(rule: dict) -> Column:
    """True where a row breaks the rule {rule_type, ...}."""
    kind, d = rule["rule_type"], rule.get("rule_definition", rule)
    no = F.lit(False)
    if kind == "non_negative":
        return F.coalesce(exprs.number(d["column"]) < 0, no)
    if kind == "not_null":
        return F.col(d["column"]).isNull()
    if kind == "range":
        low, high = d.get("min", d.get("minimum")), d.get("max", d.get("maximum"))
        if low is None and high is None:
            raise ValueError("a range needs a minimum or a maximum")
        v = exprs.number(d["column"])
        return F.coalesce(v < low if low is not None else no, no) | F.coalesce(v > high if high is not None else no, no)
    if kind == "allowed_values":
        return ~F.coalesce(F.col(d["column"]).isin(*d["values"]), no)
    if kind == "date_order":
        return F.coalesce(exprs.parse_date(d["start"]) > exprs.parse_date(d["end"]), no)
    raise ValueError(f"unknown rule type {kind!r}")


def active(rules: list[dict]) -> list[dict]:
    return [r for r in rules if r.get("is_active", True)]


def report(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, violations, total_rows, invalid_rows) in one pass over the table."""
    live = active(rules)
    flags = [violation(r) for r in live]
    any_flag = flags[0] if flags else F.lit(False)
    for f in flags[1:]:
        any_flag = any_flag | f
    counts = df.agg(F.count("*").alias("total_rows"), F.count_if(any_flag).alias("invalid_rows"), *(F.count_if(f).alias(f"r{i}") for i, f in enumerate(flags)))
    rows = F.array(*(F.struct(F.lit(r.get("name", r["rule_type"])).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(live)))
    return counts.select(F.inline(rows), "total_rows", "invalid_rows")


def valid_rows(df: DataFrame, rules: list[dict]) -> DataFrame:
    for r in active(rules):
        df = df.filter(~violation(r))
    return df


def domain_valid(rule: dict) -> Column:
    """True where a row keeps a discovered rule; here a missing number breaks non_negative."""
    kind = rule["rule_type"]
    if kind == "non_negative":
        return F.coalesce(exprs.number(rule["target"]) >= 0, F.lit(False))
    if kind == "chronological_date":
        return F.coalesce(exprs.parse_date(rule["end"]) >= exprs.parse_date(rule["start"]), F.lit(True))
    if kind == "arithmetic":
        made = exprs.OPERATIONS[rule["operation"]](*(exprs.number(o) for o in rule["operands"]))
        return exprs.is_close(made, exprs.number(rule["target"]))
    return F.lit(True)


def domain_mask(rules: list[dict]) -> Column:
    mask = F.lit(True)
    for r in rules:
        mask = mask & domain_valid(r)
    return mask


def domain_validity(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(validity): percentage of rows that keep every rule; 100 without rules."""
    return df.agg(F.round(F.coalesce(F.avg(domain_mask(rules).cast("int")) * 100, F.lit(100.0)), 4).alias("validity"))


def candidates(columns: list[str], operations: tuple[str, ...]) -> list[tuple[str, str, str, str]]:
    """(operation, left, right, target); the order of operands matters to - and / only."""
    out = []
    for op in operations:
        pairs = combinations(columns, 2) if op in ("add", "multiply") else permutations(columns, 2)
        out += [(op, a, b, t) for a, b in pairs for t in columns if t not in (a, b)]
    return out


FOUND = "operation string, left_column string, right_column string, target string, accuracy double"


def scan_arithmetic(df: DataFrame, columns: list[str] | None = None, operations=("add", "subtract", "multiply", "divide"), least: float = 0.99, rtol: float = 1e-5, atol: float = 1e-2, tried: list | None = None) -> DataFrame:
    """(operation, left_column, right_column, target, accuracy) of candidates that hold for ``least`` of the rows.

    A division's accuracy counts rows whose divisor is not 0, however few. All column triples,
    or those in ``tried``, are counted together, in two scans of the table at most.
    """
    columns = columns or profile.numeric_columns(df)
    numbers = df.select(*(exprs.number(c).alias(c) for c in columns))
    return df.sparkSession.createDataFrame(arithmetic.holding(numbers, columns, tuple(operations), least, rtol, atol, tried), FOUND)


def detect_arithmetic(df: DataFrame, columns: list[str] | None = None, corr_least: float = 0.7, sample: int = 500, sample_least: float = 0.95, least: float = 0.99, cap: int | None = None) -> list[dict]:
    """Rules target = left op right: pairs that correlate, a sample first, then the whole table.

    Of more than ``cap`` columns, where one is given, only the first are looked at; a warning names how many are not.
    """
    from weftline.operators.compare import correlation_long

    columns = columns or profile.numeric_columns(df)
    if cap is not None and len(columns) > cap:
        warnings.warn(f"{len(columns) - cap} number columns beyond the first {cap} are not looked at", stacklevel=2)
        columns = columns[:cap]
    if len(columns) < 3:
        return []
    filled = df.select(*(F.coalesce(exprs.number(c), F.lit(0.0)).alias(c) for c in columns))
    related = {frozenset((r["column_a"], r["column_b"])) for r in correlation_long(filled, columns).filter(F.abs("correlation") >= corr_least).collect()}
    todo = [c for c in candidates(columns, ("add", "subtract", "multiply", "divide")) if frozenset((c[1], c[3])) in related or frozenset((c[2], c[3])) in related]
    if not todo:
        return []
    head = df.select(*columns).orderBy(exprs.md5_order(*columns)).limit(sample)
    few = [(r["operation"], r["left_column"], r["right_column"], r["target"]) for r in scan_arithmetic(head, columns, least=sample_least, rtol=1e-4, tried=todo).collect()]
    full = scan_arithmetic(df, columns, least=least, tried=few).orderBy("operation", "left_column", "right_column", "target").collect() if few else []
    return [{"rule_type": "arithmetic", "operation": r["operation"], "operands": [r["left_column"], r["right_column"]], "target": r["target"], "confidence": r["accuracy"]} for r in full]


def first_per_target(rules: list[dict]) -> list[dict]:
    seen: dict[str, dict] = {}
    for r in rules:
        seen.setdefault(r["target"], r)
    return list(seen.values())


def without_circles(rules: list[dict]) -> list[dict]:
    """The rules, first come first kept, but for those whose operands are made of their own target."""
    made: dict[str, set[str]] = {}
    out = []
    for r in rules:
        operands = r.get("operands") or [r["start"]]
        needs = set(operands).union(*(made.get(o, set()) for o in operands))
        if r["target"] in needs:
            continue
        made[r["target"]] = needs
        for known in made.values():
            if r["target"] in known:
                known |= needs
        out.append(r)
    return out


def detect_derived(df: DataFrame, columns: list[str] | None = None, least: float = 0.98, dates: list[str] | None = None) -> list[dict]:
    """Derived columns, each target once; multiplication is preferred to sums, differences and ratios.

    Of two ``dates`` of which the second hardly ever comes first, the second is derived: the
    first and a number of days, {end}__diff_days.
    """
    columns = columns or profile.numeric_columns(df)
    if df.limit(5).count() < 5:
        return []
    spans = []
    for r in chronology(df, list(combinations(dates, 2))).collect() if dates and len(dates) > 1 else []:
        if r["pairs"] > 20 and r["forward"] > 0.95:
            spans.append({"rule_type": "date_difference", "start": r["first_column"], "target": r["second_column"], "days": f"{r['second_column']}__diff_days"})
    rank = {"multiply": 0, "add": 1, "subtract": 2, "divide": 3}
    found = scan_arithmetic(df, columns, least=least, rtol=1e-3).collect()
    found.sort(key=lambda r: (columns.index(r["left_column"]), columns.index(r["right_column"]), rank[r["operation"]]))
    arithmetic = [{"rule_type": "arithmetic", "operation": r["operation"], "operands": [r["left_column"], r["right_column"]], "target": r["target"], "confidence": r["accuracy"]} for r in found]
    return without_circles(first_per_target(arithmetic + spans))


def with_spans(df: DataFrame, rules: list[dict]) -> DataFrame:
    """The end dates of date differences as days behind their start, which is what a generator learns."""
    spans = [r for r in rules if r["rule_type"] == "date_difference" and {r["start"], r["target"]} <= set(df.columns)]
    days = {r["days"]: (F.unix_timestamp(exprs.parse_date(r["target"])) - F.unix_timestamp(exprs.parse_date(r["start"]))) / 86400 for r in spans}
    return df.withColumns(days).drop(*(r["target"] for r in spans)) if spans else df


def apply_spans(df: DataFrame, rules: list[dict]) -> DataFrame:
    """End dates again from their start and the days behind it; the days go."""
    for r in rules:
        if r["rule_type"] == "date_difference" and {r["start"], r["days"]} <= set(df.columns):
            df = df.withColumn(r["target"], exprs.add_days(r["start"], r["days"])).drop(r["days"])
    return df


def apply_derived(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Recompute what was derived: numbers from their operands, end dates from their start."""
    return apply_spans(apply_arithmetic(df, rules), rules)


def detect_domain(df: DataFrame, numbers: list[str] | None = None, dates: list[str] | None = None) -> list[dict]:
    """Arithmetic (95 %), chronology (95 %, with the 99.5th percentile of its lead time) and non-negativity (99 %)."""
    numbers = profile.numeric_columns(df) if numbers is None else numbers
    found = scan_arithmetic(df, numbers, ("multiply", "subtract", "add"), 0.95, 1e-3).collect() if len(numbers) >= 3 else []
    rank = {"multiply": 0, "subtract": 1, "add": 2}
    found.sort(key=lambda r: (numbers.index(r["left_column"]), numbers.index(r["right_column"]), rank[r["operation"]]))
    rules = first_per_target([{"rule_type": "arithmetic", "operation": r["operation"], "operands": [r["left_column"], r["right_column"]], "target": r["target"], "confidence": r["accuracy"]} for r in found])
    for r in chronology(df, list(combinations(dates or [], 2))).filter("pairs >= 20").collect() if dates and len(dates) > 1 else []:
        if r["forward"] >= 0.95:
            rules.append({"rule_type": "chronological_date", "start": r["first_column"], "end": r["second_column"], "max_days": r["p995_forward"], "target": r["second_column"]})
        elif r["backward"] >= 0.95:
            rules.append({"rule_type": "chronological_date", "start": r["second_column"], "end": r["first_column"], "max_days": r["p995_backward"], "target": r["first_column"]})
    if numbers:
        shares = df.agg(*(F.avg((exprs.number(c) >= 0).cast("int")).alias(c) for c in numbers)).first()
        rules += [{"rule_type": "non_negative", "target": c} for c in numbers if (shares[c] or 0) >= 0.99]
    return rules


def chronology(df: DataFrame, pairs: list[tuple[str, str]], exact: bool = True) -> DataFrame:
    """For each pair of date columns: comparable rows, shares in either order and the 99.5th percentile of days."""
    days = [(F.unix_timestamp(exprs.parse_date(b)) - F.unix_timestamp(exprs.parse_date(a))) / 86400 for a, b in pairs]
    spans = df.select(*(x.alias(f"d{i}") for i, x in enumerate(days)))
    row = spans.agg(*(f(F.col(f"d{i}")).alias(f"{k}{i}") for i in range(len(pairs)) for k, f in (("n", F.count), ("f", lambda c: F.count_if(c >= 0)), ("b", lambda c: F.count_if(c <= 0))))).first()
    sides = spans.select(*(F.when(F.col(f"d{i}") >= 0, F.col(f"d{i}")).alias(f"f{i}") for i in range(len(pairs))), *(F.when(F.col(f"d{i}") <= 0, -F.col(f"d{i}")).alias(f"b{i}") for i in range(len(pairs))))
    far = profile.quantiles(sides, sides.columns, [0.995], exact)
    rows = [(a, b, row[f"n{i}"], row[f"f{i}"] / row[f"n{i}"], row[f"b{i}"] / row[f"n{i}"], *(far[f"{k}{i}"][0] if f"{k}{i}" in far else None for k in "fb")) for i, (a, b) in enumerate(pairs) if row[f"n{i}"]]
    return df.sparkSession.createDataFrame(rows, "first_column string, second_column string, pairs long, forward double, backward double, p995_forward double, p995_backward double")


def apply_arithmetic(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Recompute the targets; where the result is null (a zero divisor) the old value stays, and whole numbers stay whole."""
    kinds = dict(df.dtypes)
    for r in rules:
        if r["rule_type"] != "arithmetic" or not {r["target"], *r["operands"]} <= set(df.columns):
            continue
        made = exprs.OPERATIONS[r["operation"]](*(exprs.number(o) for o in r["operands"]))
        made = F.round(made).cast(kinds[r["target"]]) if kinds[r["target"]] in ("int", "bigint", "smallint") else made
        df = df.withColumn(r["target"], F.coalesce(made, F.col(r["target"])))
    return df


def date_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """Start and end columns by the tokens in their names; each start gets one end."""
    is_end = lambda c: any(t in c.lower() for t in words.END_TOKENS)
    starts = [c for c in columns if any(t in c.lower() for t in words.START_TOKENS) and not is_end(c)]
    ends = [c for c in columns if is_end(c)]
    return [(s, next(e for e in ends if e != s)) for s in starts if any(e != s for e in ends)]


def quality_metrics(df: DataFrame, dates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(metric, value): completeness, duplicate rows and reversed dates, in per cent."""
    pairs = date_pairs(df.columns) if dates is None else dates
    row_key = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns))
    cells = sum((exprs.missing(c).cast("long") for c in df.columns), F.lit(0).cast("long"))
    bad = sum((F.coalesce(exprs.parse_date(e) < exprs.parse_date(s), F.lit(False)).cast("long") for s, e in pairs), F.lit(0).cast("long"))
    both = sum(((exprs.parse_date(s).isNotNull() & exprs.parse_date(e).isNotNull()).cast("long") for s, e in pairs), F.lit(0).cast("long"))
    groups = df.select(row_key.alias("k"), cells.alias("m"), bad.alias("bad"), both.alias("both")).groupBy("k").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("m", "bad", "both")))
    sums = groups.agg(F.sum("n").alias("n"), F.count("*").alias("d"), *(F.sum(c).alias(c) for c in ("m", "bad", "both")))
    width = max(1, len(df.columns))
    value = lambda v: F.round(v, 4)
    rows = F.array(
        F.struct(F.lit("completeness").alias("metric"), value(F.lit(100.0) - exprs.divide(F.col("m") * 100, F.col("n") * width)).alias("value")),
        F.struct(F.lit("duplicate_rate").alias("metric"), value(exprs.divide((F.col("n") - F.col("d")) * 100, "n")).alias("value")),
        F.struct(F.lit("date_violation_rate").alias("metric"), value(exprs.divide(F.col("bad") * 100, "both")).alias("value")),
    )
    return sums.select(F.inline(rows))


def metric_delta(before: DataFrame, after: DataFrame, lower_is_better: tuple[str, ...] = ("duplicate_rate", "date_violation_rate")) -> DataFrame:
    """(metric, value_before, value_after, delta, status) of two metric tables."""
    joined = before.withColumnRenamed("value", "value_before").join(after.withColumnRenamed("value", "value_after"), "metric", "full")
    delta = F.round(F.col("value_after") - F.col("value_before"), 4)
    gain = F.when(F.col("metric").isin(*lower_is_better), -delta).otherwise(delta)
    status = F.when(delta.isNull(), "not_available").when(gain > 0, "improved").when(gain < 0, "regressed").otherwise("unchanged")
    return joined.select("metric", "value_before", "value_after", delta.alias("delta"), status.alias("status"))
