"""Counting the hits of every rule target = left op right, for all column triples at once.

A task takes rows as Arrow batches. For each row the values of all column pairs are looked up
among the row's sorted targets, whose tolerances make intervals that rise with them; what lies
in an interval is compared exactly. So a row costs pairs times log(columns), not an expression
per triple, and a task sends one number for every triple that was hit at all.

Two scans settle any number of columns. The first tries all triples on a slice of the rows
and counts the rows of the whole table; since hits outside the slice are at most its rows, a
triple that cannot reach the wanted share any more is out, exactly. The second counts the few
others on every row. A table below ``SMALL`` rows is its own slice and needs one scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("add", "subtract", "multiply", "divide")
CALCULATE = {"add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": np.divide}
#: Rows below which the slice is the whole table, and hits that a task holds before it adds them up.
SMALL, HELD = 4096, 2_000_000
#: Columns up to which whole batches are compared at once instead of row by row.
FEW = 16


class Pairs:
    """The operand pairs of some operations, numbered: unordered for + and *, ordered for - and /."""

    def __init__(self, columns: int, operations: tuple[str, ...]):
        once, both = np.triu_indices(columns, 1), np.nonzero(~np.eye(columns, dtype=bool))
        self.columns, self.parts, at = columns, [], 0
        for op in operations:
            left, right = once if op in ("add", "multiply") else both
            self.parts.append((op, at, left, right))
            at += len(left)
        self.left, self.right = (np.concatenate([p[i] for p in self.parts]) for i in (2, 3))

    def values(self, x: np.ndarray) -> np.ndarray:
        """The value of every pair, in a row or in a block of rows."""
        return np.concatenate([CALCULATE[op](x[..., left], x[..., right]) for op, _, left, right in self.parts], axis=-1)

    def triple(self, code: int) -> tuple[str, int, int, int]:
        """(operation, left, right, target) of a code, which is pair * columns + target."""
        pair, target = divmod(code, self.columns)
        op = next(op for op, at, left, _ in reversed(self.parts) if pair >= at)
        return op, int(self.left[pair]), int(self.right[pair]), target

    def code(self, op: str, left: int, right: int, target: int) -> int:
        at, lefts, rights = next((p[1], p[2], p[3]) for p in self.parts if p[0] == op)
        return int(at + np.flatnonzero((lefts == left) & (rights == right))[0]) * self.columns + target


def numbers_of(batch: pa.RecordBatch) -> np.ndarray:
    """A row per record; null is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) if batch.num_columns else np.zeros((batch.num_rows, 0))


def row_hits(x: np.ndarray, pairs: Pairs, rtol: float, atol: float) -> np.ndarray:
    """Codes of the triples that a row hits."""
    order = np.argsort(x)
    t = x[order]
    slack = (atol + rtol * np.abs(t)) * (1 + 1e-9) + 1e-9 * np.abs(t)
    v = pairs.values(x)
    first, last = np.searchsorted(t + slack, v, "left"), np.searchsorted(t - slack, v, "right")
    some = np.flatnonzero(last > first)
    n = (last - first)[some]
    pair = np.repeat(some, n)
    target = order[np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    own = x[target]
    true = (np.abs(v[pair] - own) <= atol + rtol * np.abs(own)) & (target != pairs.left[pair]) & (target != pairs.right[pair])
    return pair[true] * pairs.columns + target[true]


def block_hits(x: np.ndarray, pairs: Pairs, pair: np.ndarray, target: np.ndarray, rtol: float, atol: float) -> np.ndarray:
    """How many rows of a block hit each of the given triples, sorted by pair."""
    limit = atol + rtol * np.abs(x)
    out = np.zeros(len(pair), np.int64)
    for at in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1) if len(pair) else []:
        p = pair[at[0]]
        op = next(op for op, begin, _, _ in reversed(pairs.parts) if p >= begin)
        v = CALCULATE[op](x[:, pairs.left[p]], x[:, pairs.right[p]])[:, None]
        out[at] = (np.abs(v - x[:, target[at]]) <= limit[:, target[at]]).sum(0)
    return out


def all_triples(pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    pair, target = np.repeat(np.arange(len(pairs.left)), pairs.columns), np.tile(np.arange(pairs.columns), len(pairs.left))
    keep = (target != pairs.left[pair]) & (target != pairs.right[pair])
    return pair[keep], target[keep]


def count_hits(batches, pairs: Pairs, rtol: float, atol: float, codes: np.ndarray | None = None):
    """mapInArrow: (code, hits) of a task; below 0 stand the rows (-1) and those in which a column is a divisor (-2 and down)."""
    rows, divisors, known = 0, np.zeros(pairs.columns, np.int64), None
    if codes is not None or pairs.columns <= FEW:
        pair, target = all_triples(pairs) if codes is None else np.divmod(codes, pairs.columns)
        known = (pair, target, np.zeros(len(pair), np.int64))
    held, size, sums = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def added(sums, held):
        code, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        both, at = np.unique(np.concatenate([sums[0], code]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([sums[1], n]), len(both)).astype(np.int64)

    with np.errstate(all="ignore"):
        for batch in batches:
            x = numbers_of(batch)
            rows += len(x)
            divisors += ((x != 0) & ~np.isnan(x)).sum(0)
            if known:
                for at in range(0, len(x), 8192):
                    known[2][:] += block_hits(x[at : at + 8192], pairs, known[0], known[1], rtol, atol)
                continue
            for row in x:
                held.append(row_hits(row, pairs, rtol, atol))
                size += len(held[-1])
                if size > HELD:
                    sums, held, size = added(sums, held), [], 0
    code, n = (known[0] * pairs.columns + known[1], known[2]) if known else added(sums, held)
    code = np.concatenate([code, [-1], -2 - np.arange(pairs.columns)]).astype(np.int64)
    n = np.concatenate([n, [rows], divisors]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(code[n > 0]), pa.array(n[n > 0])], ["code", "hits"])


def hits(df: DataFrame, pairs: Pairs, rtol: float, atol: float, codes: np.ndarray | None = None) -> DataFrame:
    counted = df.mapInArrow(lambda b: count_hits(b, pairs, rtol, atol, codes), "code long, hits long")
    return counted.groupBy("code").agg(F.sum("hits").alias("hits"))


def totals_of(found: list, pairs: Pairs) -> tuple[int, list[int]]:
    known = {r["code"]: r["hits"] for r in found if r["code"] < 0}
    return known.get(-1, 0), [known.get(-2 - c, 0) for c in range(pairs.columns)]


def reaching(counts: DataFrame, pairs: Pairs, least: list[float]) -> list:
    """What no longer needs a look at rows: totals, and the triples with enough hits; ``least`` has a bound for divisions by each column, then that for the others."""
    begin = next((at for op, at, _, _ in pairs.parts if op == "divide"), len(pairs.left))
    pair = F.floor(F.col("code") / pairs.columns)
    divided, rest = pair - begin, max(1, pairs.columns - 1)
    right = F.pmod(divided, F.lit(rest))
    right = right + (right >= F.floor(divided / rest)).cast("long")
    bound = F.when(pair >= begin, F.element_at(F.array(*map(F.lit, least[:-1])), (right + 1).cast("int"))).otherwise(F.lit(least[-1])) if begin < len(pairs.left) else F.lit(least[-1])
    return counts.filter((F.col("code") < 0) | (F.col("hits") >= bound)).collect()


def holding(df: DataFrame, columns: list[str], operations: tuple[str, ...], least: float, rtol: float, atol: float, tried: list | None = None) -> list[tuple[str, str, str, str, float]]:
    """(operation, left, right, target, share of rows) of the triples that hold for ``least`` of the rows; ``df`` has one double column for each of ``columns``.

    A division's share counts the rows whose divisor is neither 0 nor null.
    """
    # divisions stand last, so that their codes are those from some number on
    operations = tuple(op for op in OPERATIONS if op in operations)
    if len(columns) < 3 or not operations:
        return []
    pairs = Pairs(len(columns), operations)
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c) != 0).alias(f"d{i}") for i, c in enumerate(columns))).first()
    rows, divisors = row["n"], [row[f"d{i}"] for i in range(len(columns))]
    share = 1.0 if rows <= SMALL else min(1.0, max(3 * (1 - least), SMALL / rows))
    part = df if share >= 1 else df.filter(F.rand(42) < share)
    if len(columns) > FEW:
        part = part.repartition(df.sparkSession.sparkContext.defaultParallelism)  # the slice only; a row of many columns is much work
    needed = lambda total, seen: math.ceil(least * total - 1e-9 * total) - (total - seen)
    counts = hits(part, pairs, rtol, atol)
    if share >= 1:
        bounds = [*(float(max(1, needed(d, d))) for d in divisors), float(max(1, needed(rows, rows)))]
    else:
        from weftline.functions.storage import settle

        counts = settle(counts)
        seen, by = totals_of(counts.filter("code < 0").collect(), pairs)
        bounds = [*(float(max(0, needed(d, s))) for d, s in zip(divisors, by)), float(max(0, needed(rows, seen)))]
        if bounds[-1] <= 0:  # an unlucky slice rules nothing out
            share, counts = 1.0, hits(df, pairs, rtol, atol)
            bounds = [*(float(max(1, needed(d, d))) for d in divisors), float(max(1, needed(rows, rows)))]
    found = {r["code"]: r["hits"] for r in reaching(counts, pairs, bounds) if r["code"] >= 0}
    names = {c: i for i, c in enumerate(columns)}
    if tried is not None:
        wanted = {pairs.code(op, names[a], names[b], names[t]) for op, a, b, t in tried}
        found = {k: n for k, n in found.items() if k in wanted}
    if share < 1 and "divide" in operations:
        # a divisor that is 0 nearly everywhere: its slice says nothing, not even of triples without a hit
        rare = [i for i, d in enumerate(divisors) if d and bounds[i] <= 0]
        at, left, right = next(p[1:] for p in pairs.parts if p[0] == "divide")
        unknown = {int(at + k) * pairs.columns + t for i in rare for k in np.flatnonzero(right == i) for t in range(pairs.columns) if t not in (i, left[k])}
        found |= dict.fromkeys(unknown if tried is None else unknown & wanted, 0)
    if share < 1 and found:
        codes = np.array(sorted(found), np.int64)
        found = {r["code"]: r["hits"] for r in hits(df, pairs, rtol, atol, codes).filter("code >= 0").collect()}
    out = []
    for code in sorted(found):
        op, a, b, t = pairs.triple(code)
        total = divisors[b] if op == "divide" else rows
        if total and found[code] / total >= least:
            out.append((op, columns[a], columns[b], columns[t], found[code] / total))
    return out
