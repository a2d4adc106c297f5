"""Text answers, providers, linked tables, peers, streams, partial updates and odd files."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from weftline.functions import exprs
from weftline.operators import clean, generate, keys, ml, profile, repair, rules, shape, text
from weftline.plans import lifecycle, metadata
from weftline.sources import readers, sinks
from weftline.streaming import batches

SF = "/root/testdata/sf0.001"


def test_nearest_peer_is_brute_force(spark):
    rng = random.Random(1)
    ids = rng.sample(range(1000), 300)
    rows = [(rng.choice([1, 2, 3]), rng.choice([0, 10, 10, 50, 7200, 90_000, rng.randrange(100_000)]), i) for i in ids] + [(9, 5, 5000), (7, 0, 2050), (7, 10, 2001), (7, 10, 2049)]
    df = spark.createDataFrame(rows, "k int, t long, id long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: (r["peer_id"], r["gap_seconds"]) for r in metadata.nearest_peer(df, "k", "ts", "id").collect()}
    want = {}
    for k, t, i in rows:
        near = min(((abs(t - u), abs(i - j), -j) for m, u, j in rows if m == k and j != i), default=None)
        if near:
            want[i] = (-near[2], near[0])
    assert got == want and got[2050] == (2049, 10) and 5000 not in got


def test_utility_after_an_observation_and_of_many_categories(spark, tmp_path):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    sinks.save_tables({"a": spark.range(2)}, f"file://{tmp_path}/all")
    df = spark.range(1200).select("id", (F.col("id") % 3).cast("string").alias("label"), F.concat(F.lit("v"), (F.col("id") % 400).cast("string")).alias("many"), (F.col("id") % 3 + F.rand(1)).alias("x"))
    row = ml.utility(df, df, "label", ["id"]).first()
    assert row["status"] == "evaluated" and row["score"] > 90


def test_stream_counts_every_window(spark):
    got = {(r["window_start"], r["event_type"]): (r["n"], round(r["total"], 4)) for r in batches.windowed_counts(spark, SF, 1).collect()}
    e = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))
    assert got == {(r["d"], r["event_type"]): (r["n"], r["s"]) for r in e.collect()}


def test_copula_keeps_rare_categories(spark):
    df = spark.range(1500).select(F.concat(F.lit("c"), (F.col("id") % 750).cast("string")).alias("c"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("d"), (F.col("id") % 7).cast("double").alias("x"))
    model = generate.GaussianCopula(max_categories=50).fit(df)
    made = model.generate(spark, 6000)
    assert made.columns == ["c", "d", "x"] and made.count() == 6000
    assert made.select("c").distinct().count() > 700 and made.join(df.select("c").distinct(), "c", "left_anti").isEmpty()
    from collections import Counter

    part, whole = Counter(model.generate(spark, 100, 50).collect()), Counter(model.generate(spark, 150).collect())
    assert sum(part.values()) == 100 and not part - whole


def test_normal_scores():
    import numpy as np
    from statistics import NormalDist

    p = np.array([1e-6, 0.001, 0.1, 0.5, 0.9, 0.999, 1 - 1e-6])
    assert np.allclose(generate.normal_quantile(p), [NormalDist().inv_cdf(x) for x in p], atol=2e-3)
    x = np.linspace(-5, 5, 41)
    assert np.allclose(generate.normal_cdf(x), [NormalDist().cdf(v) for v in x], atol=2e-7)


ANSWERS = [
    ('```json\n[{"id": 10, "text": "Good cream"}, {"id": 11, "text": "\\"Fine\\""}]\n```', [10, 11], {10: "Good cream", 11: "Fine"}),
    ('Here you are: {"records": [{"record_id": "5", "value": "One"}, {"index": 6, "content": "Two"}]}', [5, 6], {5: "One", 6: "Two"}),
    ('[{"id": 0, "text": "a b"}, {"id": 1, "text": "c d"}]', [20, 21], {20: "a b", 21: "c d"}),
    ('["first text", "second text"]', [7, 8], {7: "first text", 8: "second text"}),
    ('[{"id": 1, "text": "N/A"}, {"id": 2, "text": "kept"}]', [1, 2], {2: "kept"}),
    ('[{"id": 1, "text": "cut off', [1], {}),
    ("", [1], {}),
    (None, [1], {}),
]


@pytest.mark.parametrize("answer,ids,want", ANSWERS)
def test_answers_by_id(spark, answer, ids, want):
    df = spark.createDataFrame([(answer, ids)], "answer string, ids array<long>")
    assert {r["id"]: r["text"] for r in text.answers_by_id(df, "answer", "ids").collect()} == want


def test_answer_lines(spark):
    cases = [("1. First text\n2) Second text\n- Third text", ["First text", "Second text", "Third text"]), ('{"values": ["x y", "z w"]}', ["x y", "z w"]), ('{"id": 1, "text": "cut', []), ("Sure! Here:\nplain", ["plain"])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "a string")
    got = [r[0] for r in df.select(text.answer_lines(F.col("a"))).collect()]
    assert got[:3] == [w for _, w in cases[:3]] and got[3] == ["plain"]


def test_provided_texts_are_new_and_complete(spark):
    real = spark.createDataFrame([("the known text",), ("another known text",)], "t string")

    def provider(ids, examples):
        import json

        return json.dumps([{"id": i, "text": "the known text" if i % 5 == 0 else "always the same" if i % 7 == 0 else f"fresh text {i}"} for i in ids if i % 11])

    made = [r["t"] for r in generate.generator("llm_text", column="t", provider=provider, batch=4, retries=2).fit(real).generate(spark, 60).collect()]
    assert len(made) == 60 and None not in made
    fresh = [t for t in made if t.startswith("fresh")]
    assert len(fresh) == len(set(fresh)) == sum(1 for i in range(60) if i % 11 and i % 5 and i % 7) and made.count("always the same") == 1


def test_date_differences(spark):
    df = spark.range(60).select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("ordered"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") + F.col("id") % 9).cast("int")), "yyyy-MM-dd").alias("delivered"))
    found = rules.detect_derived(df, [], dates=["ordered", "delivered"])
    assert found == [{"rule_type": "date_difference", "start": "ordered", "target": "delivered", "days": "delivered__diff_days"}]
    spans = rules.with_spans(df, found)
    assert spans.columns == ["ordered", "delivered__diff_days"]
    assert sorted(map(tuple, rules.apply_derived(spans, found).select("ordered", "delivered").collect())) == sorted(map(tuple, df.collect()))
    assert spark.range(1).select(exprs.add_days(F.lit("2024-02-28"), F.lit(2)), exprs.add_days(F.lit("2024-02-28"), F.lit(-5))).first()[:] == ("2024-03-01", "2024-02-28")


def test_linked_tables_keep_their_form(spark):
    c = spark.range(1, 61).select(F.col("id").alias("cid"), F.concat(F.lit("Customer "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"), F.when(F.col("id") % 3 == 0, "gold").otherwise("basic").alias("level"), (F.col("id") % 40).cast("double").alias("age"))
    o = spark.range(1, 241).select(F.col("id").alias("oid"), ((F.col("id") * 7) % 60 + 1).alias("cid"), (F.col("id") % 9 + 1).alias("qty"), F.round(F.col("id") % 13 + 0.25, 2).alias("price")).withColumn("total", F.round(F.col("qty") * F.col("price"), 2))
    relations, primary = [("c", "cid", "o", "cid")], {"c": "cid", "o": "oid"}
    made = generate.linked({"c": c, "o": o}, relations, primary, {"c": 30, "o": 120})
    assert all(r["passed"] for r in generate.linked_report(made, relations, primary).collect())
    assert made["o"].columns == o.columns and dict(made["o"].dtypes) == dict(o.dtypes)
    assert made["o"].filter(F.abs(F.col("total") - F.col("qty") * F.col("price")) > 0.02).count() == 0
    assert made["c"].filter(F.col("name") != F.concat(F.lit("Customer "), F.lpad(F.col("cid").cast("string"), 4, "0"))).count() == 0
    assert {r["level"] for r in made["c"].select("level").distinct().collect()} == {"gold", "basic"}


def test_runs_and_partial_updates(spark):
    runs = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "run int, started int")
    results = spark.createDataFrame([(2, "b"), (1, "a")], "run int, result string")
    assert [(r["run"], r["result"]) for r in metadata.runs_with_results(runs, results, "run", "started", 2).orderBy("run").collect()] == [(2, "b"), (3, None)]
    jobs = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "job int, path string, rows int")
    changes = spark.createDataFrame([(1, None, 9)], "job int, path string, rows int")
    assert sorted(map(tuple, metadata.partial_update(jobs, changes, ["job"]).collect())) == [(1, "x", 9), (2, "y", 6)]


def test_tuning_changes_options(spark):
    real = spark.range(80).select(F.col("id").alias("rid"), (F.col("id") % 9).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    scores = iter([50.0, 60.0, 60.5])
    _, attempts = lifecycle.autotune(real, "rid", 40, score=lambda r, m: next(scores))
    assert [a["options"].get("seed", 42) for a in attempts] == [42, 55, 81] and attempts[0]["weak"] == ["statistical"]
    assert lifecycle.tuned("llm_text", {"similarity": 0.93}, 1) == {"similarity": 0.95}


def test_csv_fields_with_line_breaks(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('id,note,x\n1,"two\nlines",3\n2,"a ""b""",4\n')
    rows = readers.read_table(spark, f"file://{p}").orderBy("id").collect()
    assert [(r["id"], r["note"], r["x"]) for r in rows] == [(1, "two\nlines", 3), (2, 'a "b"', 4)]


def test_wrapped_rows_that_look_like_the_header(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text('"a,b"\n"1,2"\n"a,b"\n"3,""x, y"""\n')
    assert sorted(map(str, (tuple(r) for r in readers.read_csv(spark, f"file://{p}", infer=False).collect()))) == ["('1', '2')", "('3', 'x, y')", "('a', 'b')"]


def test_fills_by_name_and_kind(spark):
    df = spark.createDataFrame([("2024-01-01", True, "x", 1.0, None), (None, None, None, None, None), ("2024-01-05", True, "x", 3.0, None), ("2024-01-03", False, "y", 2.0, None)], "ship_date string, ok boolean, s string, v double, amount double")
    r = clean.impute(df).filter("v = 2 and s = 'x'").first()
    assert (r["ship_date"], r["ok"], r["s"], r["amount"]) == ("2024-01-03", True, "x", "unknown")
    empty = spark.createDataFrame([(None, None, None, None, None)], df.schema)
    part = spark.createDataFrame([("2024-02-01", None, "q", None, 5.0), (None, True, None, 1.0, None)], df.schema)
    filled = clean.impute(part, empty).orderBy(F.desc("s")).collect()
    assert {f["ship_date"] for f in filled} == {"2024-02-01", "2000-01-01"} and {f["amount"] for f in filled} == {5.0, 0.0} and {f["ok"] for f in filled} == {True, False}


def test_preprocess_checks_its_result(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 != 0, F.col("id") * 2.0).alias("total_cost"), (F.col("id") % 5 + 1).alias("quantity"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), F.when(F.col("id") == 7, 9000.0).otherwise(F.col("id") % 6).alias("odd"))
    run = clean.preprocess_run(df)
    assert {"cost_per_unit", "kind_a", "kind_b"} <= set(run["table"].columns) and run["table"].count() == 40
    assert {r["column_name"]: (r["iqr"], r["zscore"]) for r in run["outliers"].collect()}["odd"] == (1, 1)
    assert clean.preprocess(df, for_generation=True).columns == df.columns


@pytest.mark.parametrize("accuracy", [10_000, 8])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    """By sketches good and bad; many equal values, gaps and one empty column."""
    import numpy as np

    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    rng = random.Random(9)
    values = [(float(rng.choice([rng.randrange(2000), 7, 7])), rng.random() if rng.random() < 0.9 else None, None) for _ in range(3000)]
    points = [0.0, 0.25, 0.5, 0.995, 1.0]
    got = profile.quantiles(spark.createDataFrame(values, "a double, b double, c double"), ["a", "b", "c"], points)
    assert set(got) == {"a", "b"}
    for i, c in enumerate("ab"):
        assert np.allclose(got[c], np.quantile([v[i] for v in values if v[i] is not None], points))


def test_cumulative_sums_over_slices(spark, monkeypatch):
    monkeypatch.setattr(profile, "SLICE_VALUES", 20)
    rng = random.Random(3)
    rows = [("x", float(v), rng.randrange(1, 5)) for v in rng.sample(range(1000), 200)] + [("y", 1.0, 2)]
    got = {(r["column_name"], r["value"]): (r["before_n"], r["all_n"]) for r in profile.cumulative(spark.createDataFrame(rows, "column_name string, value double, n long"), ["n"]).collect()}
    assert got == {(c, v): (sum(n for d, w, n in rows if d == c and w < v), sum(n for d, _, n in rows if d == c)) for c, v, _ in rows}


def test_first_rows_are_made_once(spark):
    calls = []

    def make(n, attempt):
        calls.append(n)
        return spark.range(attempt * 1000, attempt * 1000 + n)

    out = repair.reject_and_resample(make, F.col("id") % 2 == 0, 50)
    assert out.count() == 50 == out.distinct().count() and out.filter("id % 2 = 1").isEmpty()


def test_ids_by_hashes(spark):
    rows = spark.range(300)
    made = keys.make_ids(rows, "k", ["id"], keys.id_pattern(["123e4567-e89b-42d3-a456-426614174000"] * 3))
    assert made.filter(~F.col("k").rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}$")).isEmpty() and made.select("k").distinct().count() == 300
    free = keys.make_ids(rows, "k", ["id"], {"kind": "free", "prefix": "ZZ", "length": 9}, made.select("k"))
    assert free.filter(~F.col("k").rlike(r"^ZZ[A-Z0-9]{7,}$")).isEmpty() and free.select("k").distinct().count() == 300


def test_shape_of_linked_analysis(spark):
    df = spark.range(1, 41).select(F.col("id").alias("pid"), F.concat(F.lit("P-"), F.col("id").cast("string")).alias("label"), (F.col("id") % 3).alias("a"), (F.col("id") % 4).alias("b")).withColumn("c", F.col("a") + F.col("b"))
    found = shape.analyse_table(df, [], "pid")
    assert found["functions"] == ["label"] and [r["target"] for r in found["derived"]][0] == "c"
