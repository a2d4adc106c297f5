"""Arithmetic rules of all column triples against plain loops."""

import itertools
import random

import pytest

from weftline.operators import arithmetic, rules


def plain(rows, columns, operations, least, rtol, atol):
    out = set()
    for op in operations:
        pairs = itertools.combinations(range(len(columns)), 2) if op in ("add", "multiply") else itertools.permutations(range(len(columns)), 2)
        for a, b in pairs:
            for t in range(len(columns)):
                if t in (a, b):
                    continue
                hits = total = 0
                for r in rows:
                    if op == "divide" and (r[b] is None or r[b] == 0):
                        continue
                    total += 1
                    if None in (r[a], r[b], r[t]):
                        continue
                    made = r[a] + r[b] if op == "add" else r[a] - r[b] if op == "subtract" else r[a] * r[b] if op == "multiply" else r[a] / r[b]
                    hits += abs(made - r[t]) <= atol + rtol * abs(r[t])
                if total and hits / total >= least:
                    out.add((op, columns[a], columns[b], columns[t], round(hits / total, 9)))
    return out


def rows_of(n, width, seed):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        r = [pick.choice([0.0, float(pick.randint(-9, 9)), pick.uniform(-50, 50)]) for _ in range(width)]
        r[3], r[4] = r[0] + r[1], r[0] * r[2]
        r[5] = 0.0 if pick.random() < 0.9 else pick.uniform(1, 2)
        r[6] = r[0] / r[5] if r[5] else 7.0
        if pick.random() < 0.02:
            r[3] += 5
        if pick.random() < 0.01:
            r[pick.randrange(width)] = None
        rows.append(tuple(r))
    return rows


@pytest.mark.parametrize("width,few", [(8, 16), (8, 0), (19, 16)])
def test_all_triples(spark, monkeypatch, width, few):
    monkeypatch.setattr(arithmetic, "FEW", few)
    rows, names = rows_of(150, width, 5), [f"c{i}" for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    for least in (0.95, 0.5):
        found = {(*r[:4], round(r[4], 9)) for r in map(tuple, rules.scan_arithmetic(df, least=least).collect())}
        assert found == plain(rows, names, arithmetic.OPERATIONS, least, 1e-5, 1e-2)


@pytest.mark.parametrize("few", [16, 0])
def test_a_slice_loses_no_rule(spark, monkeypatch, few):
    monkeypatch.setattr(arithmetic, "FEW", few)
    monkeypatch.setattr(arithmetic, "SMALL", 64)
    rows, names = rows_of(1500, 7, 6), [f"c{i}" for i in range(7)]
    # a divisor of three rows
    rows = [(*r[:5], float(i % 5 + 1) if i % 600 == 9 else 0.0, r[0] / (i % 5 + 1) if i % 600 == 9 and r[0] is not None else 3.5) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    found = {(*r[:4], round(r[4], 9)) for r in map(tuple, rules.scan_arithmetic(df, least=0.95).collect())}
    assert found == plain(rows, names, arithmetic.OPERATIONS, 0.95, 1e-5, 1e-2)


def test_tried_alone(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), float(i + i % 3), 0.0) for i in range(50)], "a double, b double, c double, d double")
    tried = [("add", "a", "b", "c"), ("add", "a", "b", "d"), ("subtract", "c", "b", "a")]
    assert {tuple(r)[:4] for r in rules.scan_arithmetic(df, tried=tried).collect()} == {("add", "a", "b", "c"), ("subtract", "c", "b", "a")}
    assert rules.scan_arithmetic(df.limit(0)).collect() == []


def test_sixty_columns_take_few_jobs(spark):
    n = 60
    pick = random.Random(1)
    rows = [[pick.uniform(1, 1000) for _ in range(n)] for _ in range(6000)]
    for r in rows:
        r[10], r[20], r[30] = r[0] + r[1], r[2] * r[3], r[4] - r[5]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i:02d} double" for i in range(n)))
    df = df.repartition(4).cache()
    df.count()
    context = spark.sparkContext
    context.setJobGroup("wide", "wide")
    found = {tuple(r)[:4] for r in rules.scan_arithmetic(df, least=0.98).collect()}
    jobs = context.statusTracker().getJobIdsForGroup("wide")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {("add", "c00", "c01", "c10"), ("multiply", "c02", "c03", "c20"), ("subtract", "c04", "c05", "c30")} <= found
    assert len(found) < 30 and len(jobs) <= 12
