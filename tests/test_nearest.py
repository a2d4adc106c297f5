"""Nearest rows by rings around pivots against all pairs."""

import random
from statistics import median

import pytest

from weftline.operators import compare, ml, nearest
from weftline.plans import lifecycle

SCHEMA = "k long, a double, b double, c string, d boolean"
RANGES = {"a": 10.0, "b": 3.0}


def rows_of(seed, n, start=0):
    pick = random.Random(seed)
    return [(start + i, None if pick.random() < 0.05 else round(pick.gauss(5, 2), 2), pick.choice([0.0, 1.5, 3.0, pick.uniform(0, 9)]), pick.choice(["x", "y", "z", None]), pick.random() < 0.5) for i in range(n)]


def plain(queries, reference, itself):
    def gap(x, y, r):
        return 1.0 if x is None or y is None else min(abs(x - y) / r, 1.0)

    out = {}
    for q in queries:
        d = [(gap(q[1], s[1], 10.0) + gap(q[2], s[2], 3.0) + (q[3] != s[3]) + (q[4] != s[4])) / 4 for s in reference if not (itself and s[0] == q[0])]
        out[q[0]] = round(min(d), 9) if d else None
    return out


@pytest.mark.parametrize("itself", [False, True])
def test_every_pair(spark, monkeypatch, itself):
    monkeypatch.setattr(nearest, "RING_ROWS", 8)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 32)
    reference = rows_of(1, 500) + [(1000 + i, 5.0, 1.5, "x", True) for i in range(120)]  # one row many times
    queries = reference[:300] + reference[-3:] if itself else rows_of(2, 200, 5000)
    ref, asked = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (reference, queries))
    found = {r["key"]: None if r["distance"] is None else round(r["distance"], 9) for r in nearest.gower_nearest_exact(asked, ref, ["a", "b"], ["c", "d"], RANGES, "k", itself).collect()}
    assert found == plain(queries, reference, itself)


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, 2.0, 0.0, "x", True)], SCHEMA)
    ask = lambda q, r, itself: [tuple(x) for x in nearest.gower_nearest_exact(q, r, ["a", "b"], ["c", "d"], RANGES, "k", itself).collect()]
    assert ask(one, one, False) == [(1, 0.0)] and ask(one, one, True) == [(1, None)]
    assert ask(one, one.limit(0), False) == [(1, None)] and ask(one.limit(0), one, False) == []


def test_sample_does_not_follow_the_order_of_rows(spark):
    reference, queries = rows_of(3, 400), rows_of(4, 40, 9000)
    asked = spark.createDataFrame(queries, SCHEMA)
    near = lambda r, most: sorted((x["key"], round(x["distance"], 9)) for x in compare.gower_nearest(asked, spark.createDataFrame(r, SCHEMA), ["a", "b"], ["c", "d"], RANGES, "k", most=most).collect())
    assert near(reference, 50) == near(reference[::-1], 50)
    assert dict(near(reference, None)) == plain(queries, reference, False)


def test_own_rows_without_themselves(spark, monkeypatch):
    monkeypatch.setattr(nearest, "RING_ROWS", 8)
    rows = rows_of(5, 300) + [(1000 + i, 10.0**i, 0.0, "x", True) for i in range(12)] + [(2000 + i, None, None, None, None) for i in range(3)]
    index = nearest.Index(spark.createDataFrame(rows, SCHEMA), ["a", "b"], ["c", "d"], RANGES, "k")
    want = sorted(plain(rows, rows, True).values())
    got = index.distances(index.own()).select("distance", "n").collect()
    assert sorted(round(r["distance"], 9) for r in got for _ in range(r["n"])) == want
    assert compare.medians([index.distances(index.own())] * 2) == pytest.approx([median(want)] * 2, abs=1e-9)


def test_no_row_is_far_from_the_pivots_alone(spark, monkeypatch):
    """One pivot, so cells tell nothing, and cuts between rings that fall together."""
    monkeypatch.setattr(nearest, "RING_ROWS", 16)
    monkeypatch.setattr(nearest, "PIVOTS", 1)
    monkeypatch.setattr(nearest, "AT_ONCE", 50)
    reference = [(i, float(i % 5), float(i % 7), "xyz"[i % 3] + str(i % 11), i % 2 == 0) for i in range(600)]
    queries = rows_of(6, 150, 5000)
    ref, asked = (spark.createDataFrame(r, SCHEMA) for r in (reference, queries))
    found = {r["key"]: round(r["distance"], 9) for r in nearest.gower_nearest_exact(asked, ref, ["a", "b"], ["c", "d"], RANGES, "k").collect()}
    assert found == plain(queries, reference, False)


@pytest.mark.parametrize("itself", [False, True])
def test_rows_without_columns_and_with_one_key(spark, itself):
    rows = spark.createDataFrame([(1, 0.0, 0.0, "x", True), (1, 1.0, 0.0, "y", True), (None, 2.0, 0.0, "z", True)], SCHEMA)
    ask = lambda numbers, labels: sorted(round(r["distance"], 6) for r in nearest.gower_nearest_exact(rows, rows, numbers, labels, {"a": 2.0}, "k", itself).collect())
    assert ask([], []) == [0.0] * 3
    assert ask(["a"], ["c"]) == ([0.75] * 3 if itself else [0.0] * 3)


def test_evaluation_asks_every_row(spark, monkeypatch):
    """The rows beyond the first 2,000 and 500 of a shuffled order count for the privacy score."""
    pick = random.Random(7)
    real = [(2 * i, pick.uniform(0, 1000), pick.choice("abc")) for i in range(3000)]
    fake = [(2 * i + 1, x + pick.uniform(0, 0.1), c) for i, (_, x, c) in enumerate(real[:1500])] + [(6001 + 2 * i, pick.uniform(0, 1000), pick.choice("abc")) for i in range(1200)]
    width = max(x for _, x, _ in real) - min(x for _, x, _ in real)
    near = [min(min(abs(x - y) / width, 1.0) + (c != d) for _, y, d in real if c == d) / 2 for _, x, c in fake]
    own = [min(min(abs(x - y) / width, 1.0) + (c != d) for j, y, d in real if c == d and j != i) / 2 for i, x, c in real]
    ratio = median(near) / median(own)
    tables = [spark.createDataFrame(r, "k long, size double, kind string") for r in (real, fake)]
    got = compare.privacy(*tables, "k", None, None).first()
    assert (got["dcr_synthetic"], got["dcr_real"], got["dcr_ratio"]) == pytest.approx((median(near), median(own), ratio), abs=1e-4)
    monkeypatch.setattr(ml, "utility_auto", lambda *a: spark.createDataFrame([(None,)], "score double"))
    scores = {r["metric"]: r["score"] for r in lifecycle.evaluate(*tables, "k").collect()}
    assert ratio < 1 and scores["privacy"] == pytest.approx(50 + 50 * ratio, abs=1e-3)
