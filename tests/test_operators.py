"""Literal frames with known outcomes, operator by operator."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import exprs, roles
from weftline.operators import clean, compare, encode, generate, keys, ml, profile, repair, rules, text
from weftline.plans import lifecycle, metadata


def frame(spark, schema, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_iqr(spark):
    df = frame(spark, "price long", 10, 11, 12, 13, 14, 100)
    assert column(clean.iqr_flags(df, ["price"]), "price_outlier") == [False] * 5 + [True]
    assert not any(column(clean.iqr_flags(df.filter("price < 100"), ["price"]), "price_outlier"))


def test_zscore(spark):
    df = frame(spark, "price long", *range(10, 21), 1000)
    assert column(clean.zscore_flags(df, ["price"]), "price_outlier") == [False] * 11 + [True]
    same = frame(spark, "price long", 5, 5, 5)
    assert not any(column(clean.zscore_flags(same, ["price"]), "price_outlier"))


def test_median_and_mode(spark):
    assert column(clean.impute(frame(spark, "price double", 10.0, 20.0, 30.0, None)), "price")[-1] == 20
    assert column(clean.impute(frame(spark, "price double", 10.0, 11.0, 12.0, 13.0, 14.0, 1000.0, None)), "price")[-1] == 12.5
    assert column(clean.impute(frame(spark, "category string", "Electronics", "Electronics", "Furniture", None)), "category")[-1] == "Electronics"


def test_mixed_imputation(spark):
    df = frame(spark, "quantity double, status string, delivery_date string", (2.0, "Delivered", "2026-01-02"), (None, "", None), (8.0, "Pending", "2026-01-08"))
    row = clean.impute(df).collect()[1]
    assert row["quantity"] == 5.0 and row["status"] == "Delivered" and row["delivery_date"] == "2026-01-05"


def test_blank_columns(spark):
    df = frame(spark, "amount double, description string, delivery_date timestamp", (None, "", None), (None, None, None))
    assert {v for r in clean.impute(df).collect() for v in r} == {"unknown"}
    assert column(clean.impute(frame(spark, "notes string", "", "   ", None)), "notes") == ["unknown"] * 3


def test_reference_imputation(spark):
    ref = frame(spark, "status string", "Delivered", "Delivered", "Pending")
    assert column(clean.impute(frame(spark, "status string", "", None, "Pending"), ref), "status") == ["Delivered", "Delivered", "Pending"]


def test_features(spark):
    df = frame(spark, "order_date string, delivery_date string, total_cost double, quantity long", ("2026-01-01", "2026-01-06", 100.0, 10), ("2026-01-01", "2026-01-08", 50.0, 5), ("2026-01-03", "2026-01-08", 1000.0, 0))
    out = clean.domain_features(df)
    assert column(out, "lead_time") == [5, 7, 5] and column(out, "cost_per_unit") == [10.0, 10.0, None]


def test_encoding_choice(spark):
    status = frame(spark, "status string", *["open", "closed", "open", "pending"] * 5)
    assert encode.choose(status) == {"status": "onehot"}
    assert encode.choose(frame(spark, "customer_id string", *(f"C{i}" for i in range(30)))) == {"customer_id": "skip_identifier"}
    many = frame(spark, "category string", *(f"v{i % 40}" for i in range(400)))
    assert encode.choose(many)["category"] in ("binary", "frequency", "count", "hashing")
    out = encode.one_hot(frame(spark, "price long, category string", (1, "Electronics"), (2, "Furniture"), (3, None)), "category")
    assert {"category_Electronics", "category_Furniture", "category___MISSING__"} <= set(out.columns)
    assert set(encode.prepare(status).columns) == {"status_open", "status_closed", "status_pending"}


def test_hash_bucket_of_blake2b(spark):
    import hashlib

    want = int.from_bytes(hashlib.blake2b(b"abc", digest_size=8).digest(), "big") % 16
    row = encode.hashed(frame(spark, "c string", "abc"), "c", portable=False).first()
    assert row[f"c_hash_{want}"] == 1


def test_arithmetic_rules(spark):
    stock = frame(spark, "on_hand long, reserved long, available long", (100, 20, 80), (200, 50, 150), (300, 100, 200))
    found = {(r["operation"], *r["operands"], r["target"]) for r in rules.detect_arithmetic(stock, corr_least=0.0)}
    assert ("subtract", "on_hand", "reserved", "available") in found and ("add", "reserved", "available", "on_hand") in found
    sums = frame(spark, "quantity long, price long, amount long", (2, 10, 20), (3, 20, 60), (5, 30, 150))
    found = {(r["operation"], *r["operands"], r["target"]) for r in rules.detect_arithmetic(sums)}
    assert {("multiply", "quantity", "price", "amount"), ("divide", "amount", "quantity", "price")} <= found
    assert rules.detect_arithmetic(frame(spark, "sales long, cost long, quantity long", (100, 40, 7), (250, 80, 12), (390, 120, 19))) == []


def test_arithmetic_rule_with_rare_divisors(spark):
    """A quotient that has a divisor in a few of many rows only, among more candidates than one aggregate holds."""
    d = F.when(F.col("id") % 20_000 == 7, F.col("id") % 97 + 2.0).otherwise(0.0)
    x = (F.col("id") * 7919 % 10_007).cast("double")
    table = spark.range(100_000).select(x.alias("x"), d.alias("d"), (F.when(d != 0, x / d).otherwise(x + 5)).alias("q"), (F.col("id") * 31 % 1009).cast("double").alias("other"))
    found = {tuple(r)[:4] for r in rules.scan_arithmetic(table).collect()}
    assert ("divide", "x", "d", "q") in found


def test_derived_and_domain_rules(spark):
    rows = [(i % 7 + 1, 1.5 * (i % 11 + 1), (i % 7 + 1) * 1.5 * (i % 11 + 1), f"2026-01-{i % 20 + 1:02d}", f"2026-02-{i % 20 + 1:02d}") for i in range(60)]
    df = frame(spark, "quantity int, unit_cost double, total_value double, shipment_date string, delivery_date string", *rows)
    found = rules.detect_domain(df, ["quantity", "unit_cost", "total_value"], ["shipment_date", "delivery_date"])
    kinds = {(r["rule_type"], r["target"]) for r in found}
    assert ("arithmetic", "total_value") in kinds and ("chronological_date", "delivery_date") in kinds and ("non_negative", "quantity") in kinds
    broken = df.withColumn("total_value", F.lit(0.0))
    fixed = rules.apply_arithmetic(broken, found)
    assert rules.domain_validity(broken, found).first()[0] == 0.0 and rules.domain_validity(fixed, found).first()[0] == 100.0
    assert rules.domain_validity(df, []).first()[0] == 100.0


def test_rule_edges(spark):
    df = frame(spark, "v double, s string, a string, b string", (None, None, "x", "2026-01-01"), (-1.0, "O", "2026-01-02", "2026-01-01"))
    bad = lambda r: column(df.select(rules.violation(r).alias("b")), "b")
    assert bad({"rule_type": "non_negative", "column": "v"}) == [False, True]
    assert bad({"rule_type": "range", "column": "v", "min": 0}) == [False, True]
    assert bad({"rule_type": "allowed_values", "column": "s", "values": ["O"]}) == [True, False]
    assert bad({"rule_type": "date_order", "start": "a", "end": "b"}) == [False, True]
    with pytest.raises(ValueError):
        rules.violation({"rule_type": "odd"})


def test_reject_and_resample(spark):
    batches = [[-10, -20, 30, 40], [50, 60, 70, 80]]
    out = repair.reject_and_resample(lambda n, k: frame(spark, "unit_cost long", *batches[k]), F.col("unit_cost") >= 0, 4)
    assert out.count() == 4 and min(column(out, "unit_cost")) >= 0
    with pytest.raises(RuntimeError):
        repair.reject_and_resample(lambda n, k: frame(spark, "unit_cost long", -1), F.col("unit_cost") >= 0, 1, most=2)


def test_quality_metrics(spark):
    value = lambda df, m, **o: {r["metric"]: r["value"] for r in rules.quality_metrics(df, **o).collect()}[m]
    assert value(frame(spark, "amount double, status string", (10.0, "ok"), (None, "   ")), "completeness") == 50.0
    assert value(frame(spark, "order_id long, status string", (1, "A"), (1, "A"), (2, "B")), "duplicate_rate") == 33.3333
    days = [("2026-01-01", "2026-01-02")] * 3 + [("2026-01-05", "2026-01-02")]
    assert value(frame(spark, "shipment_date string, delivery_date string", *days), "date_violation_rate") == 25.0


def test_integrity(spark):
    parents = frame(spark, "customer_id string", "C-1", "C-2", "C-3")
    orders = frame(spark, "order_id long, customer_id string", (1, "C-1"), (2, "C-2"), (3, "C-3"), (4, "C-GHOST-1"), (5, "C-GHOST-2"), (6, None))
    row = keys.integrity([("orders", orders, "customer_id", "customers", parents, "customer_id")]).first()
    assert (row["valid_rows"], row["total_rows"], row["score"]) == (3, 5, 60.0)
    assert {r["key"] for r in keys.orphan_keys(orders, "customer_id", parents, "customer_id").collect()} == {"C-GHOST-1", "C-GHOST-2"}
    assert keys.foreign_key_rows(orders, "customer_id", parents, "customer_id").first()["orphan_rows"] == 3
    assert keys.integrity([]) is None


def test_ids(spark):
    made = lambda values, n=3, **o: column(keys.make_ids(spark.range(n), "k", ["id"], keys.id_pattern(values), **o), "k")
    assert made([f"CUST-{i:04d}" for i in range(1, 43)], 5) == [f"CUST-{i:04d}" for i in range(43, 48)]
    assert made([f"ORD{i:03d}" for i in range(1, 1000)]) == ["ORD1000", "ORD1001", "ORD1002"]
    assert keys.next_integers(frame(spark, "i long", *range(1001, 1101)), "i")["start"] == 1101
    uuids = made(["2f1e4fc0-81fd-41da-9156-6a3a1d5b1d5a", "7d0b9c32-6e0c-4e2f-8d0a-3f6f0a0e7c11"])
    assert len(set(uuids)) == 3 and all(len(u) == 36 for u in uuids)
    assert all(v.startswith("EMP") for v in made(["EMP-1", "EMP_22", "EMP.x.9", "EMP77"]))
    few = frame(spark, "e string", "A0", "A1")
    assert not {"A0", "A1"} & set(made(["A0", "B7", "C3", "D9", "Z5"], 8, existing=few))


def test_similarity(spark):
    a = frame(spark, "revenue double, cost double", *[(100.0 + i, 50.0 + i) for i in range(40)])
    assert min(column(compare.statistical_similarity(a, a), "score")) == 100.0
    c = frame(spark, "status string, tier string", *[("open" if i % 3 else "closed", f"t{i % 4}") for i in range(40)])
    assert set(column(compare.statistical_similarity(c, c), "kind")) == {"categorical"}
    far = a.select((F.col("revenue") + 1000).alias("revenue"), "cost")
    assert min(column(compare.statistical_similarity(a, far), "score")) < 50
    use, other = compare.eligible(frame(spark, "user_id long, note string, order_date string", (1, "a b c d e f", "2026-01-01"), (2, "g h i j k l", "2026-01-02")))
    assert use == {} and other == {"user_id": "identifier", "note": "free_form_text", "order_date": "datetime_not_supported"} or other["order_date"] == "identifier"


def test_correlation_of_constants(spark):
    df = frame(spark, "constant_col double, varying_col double", *[(5.0, float(i)) for i in range(10)])
    score = compare.correlation_preservation(df, df, ["constant_col", "varying_col"]).first()["overall_score"]
    assert score is not None and not math.isnan(score)


def test_privacy_guard(spark):
    real = frame(spark, "item string, cost long", *zip("ABCDE", range(5)))
    synthetic = frame(spark, "item string, cost long", *zip("ABXYZ", range(5)))
    kept, dropped = repair.privacy_guard(real, synthetic, ["item"])
    assert dropped == 2 and kept.count() == 5 and compare.exact_matches(real, kept).first()["exact_matches"] == 0


def test_marginals_keep_ranks(spark):
    real = frame(spark, "k long, x double", *[(i, float(i * i)) for i in range(200)])
    synthetic = frame(spark, "k long, x double", *[(i, float((i * 37) % 200)) for i in range(200)])
    out = repair.quantile_map(real, synthetic, "x", ["k"])
    before, after = (sorted(column(d.orderBy("x", "k"), "k")) for d in (synthetic, out))
    assert before == after and column(synthetic.orderBy("x"), "k") == column(out.orderBy("x"), "k")
    gap = lambda d: compare.ks(real, d, ["x"]).first()["ks_statistic"]
    assert gap(out) < gap(synthetic) and gap(out) < 0.02


def test_split_and_fill(spark):
    df = spark.range(103)
    assert sum(column(repair.train_test_split(df, ["id"]), "is_test")) == 21
    assert sorted(column(repair.fill_up(spark.range(4), 10, ["id"]), "id")) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert sorted(column(clean.numbered(df.repartition(7), ["id"], "n", 5), "n")) == list(range(5, 108))
    drawn = repair.systematic(df.withColumn("w", F.lit(2.0)), "w", 50, ["id"])
    assert drawn.count() == 50 and drawn.distinct().count() == 50


def test_cyclical_round_trip(spark):
    days = ["2026-01-05", "2026-02-10", "2026-03-15", "2026-07-04", "2026-12-31"]
    coded = repair.cyclical(frame(spark, "order_date string", *days), "order_date")
    low, high = coded.agg(F.min("order_date__ts"), F.max("order_date__ts")).first()
    assert sorted(column(repair.decode_cyclical(coded.drop("order_date"), "order_date", low, high), "order_date")) == days


def test_text_quality(spark):
    real = frame(spark, "Text string, Sentiment string", ("I love this phone", "Positive"), ("Terrible and slow", "Negative"), ("It is fine", "Neutral"), ("Great value", "Positive"))
    fake = frame(spark, "Text string, Sentiment string", ("I love that camera", "Positive"), ("Slow and terrible", "Negative"), ("It was fine", "Neutral"), ("Great price", "Positive"))
    out = text.text_quality(real, fake, "Text")
    assert out["originality"] == 100 and out["semantic"] == 100 and out["score"] > 60
    assert column(frame(spark, "t string", "```\"Nice.\"```", "N/A", "Sure, here it is", "[1]").select(text.clean_generated(F.col("t")).alias("t")), "t") == ["Nice.", None, None, None]


def test_classifier_and_roles(spark):
    df = frame(spark, "id long, f1 double, note string, status string, empty string", *[(i, i / 7, f"the {i} words of a longer note", "open" if i % 2 else "shut", None) for i in range(40)])
    got = {r["column_name"]: r["action"] for r in lifecycle.analyse_columns(df).collect()}
    assert got == {"id": "new_id", "f1": "keep", "note": "llm", "status": "keep", "empty": "remove"}
    found = roles.business_roles(frame(spark, "order_id long, on_hand long, unit_price double, order_date string, status string, region string", *[(i, i, i * 1.5, "2026-01-01", "s", f"r{i % 3}") for i in range(30)]))
    assert found["inventory_levels"] == ["on_hand"] and found["prices"] == ["unit_price"] and found["dates"] == ["order_date"] and found["statuses"] == ["status"] and found["categories"] == ["region"]
    assert roles.normal_action("Generalize") == "keep"


def test_actions(spark):
    df = frame(spark, "id string, a double, b double", ("x", 6.0, 3.0), ("y", 1.0, 0.0))
    out = clean.apply_actions(df, {"id": "new_id", "b": "remove"}, ["a"], [{"name": "d", "operation": "divide", "columns": ["a", "b"]}])
    assert set(out.columns) == {"id", "a", "d"} and {(r["id"], r["d"]) for r in out.collect()} == {("ID_1", None), ("ID_2", 2.0)}
    assert clean.output_problems(df.limit(0)) == ["no rows"] and clean.output_problems(df, 2) == []
    with pytest.raises(ValueError):
        clean.derived(df, [{"name": "d", "operation": "add", "columns": ["a", "zz"]}])


def test_generators(spark):
    df = frame(spark, "x double, y double, c string, n long", *[(float(i), 2.0 * i + (i % 5), "ab"[i % 2], i % 9) for i in range(300)])
    model = generate.GaussianCopula().fit(df)
    out = model.generate(spark, 400)
    assert out.count() == 400 and out.stat.corr("x", "y") > 0.9
    assert sorted(map(str, model.generate(spark, 50).collect())) == sorted(map(str, model.generate(spark, 50).collect()))
    kept = generate.generate_rows(model, spark, 100, row_rules=[{"rule_type": "range", "column": "x", "min": 50}])
    assert kept.count() == 100 and kept.agg(F.min("x")).first()[0] >= 50
    with pytest.raises(RuntimeError):
        generate.generator("ctgan")
    assert [generate.batch_size(n) for n in (8, 20, 100, 500, 501)] == [5, 10, 25, 100, 200]
    assert generate.parents_first(["o", "c"], [("c", "id", "o", "cid")]) == ["c", "o"]


def test_linked_tables(spark):
    c = frame(spark, "cid long, seg string", *[(i, "ab"[i % 2]) for i in range(40)])
    o = frame(spark, "oid long, cid long, price double", *[(i, i % 10, float(i)) for i in range(120)])
    relations, primary = [("c", "cid", "o", "cid")], {"c": "cid", "o": "oid"}
    made = generate.linked({"c": c, "o": o}, relations, primary, {"c": 30, "o": 90})
    assert made["o"].count() == 90 and made["o"].columns == o.columns
    assert all(column(generate.linked_report(made, relations, primary), "passed"))


def test_ml_utility(spark):
    rows = [(i, float(i % 17), float((i * 7) % 13), "hi" if i % 17 > 8 else "lo") for i in range(160)]
    df = frame(spark, "k long, feature_1 double, feature_2 double, target string", *rows)
    out = ml.utility(df, df, "target", ["k"]).first()
    assert out["status"] == "evaluated" and out["score"] > 60
    assert ml.utility(df.limit(5), df, "target", ["k"]).first()["status"] == "not_applicable"


def test_evaluate_improve_tune(spark):
    rows = [(i, i % 9 + 1, 2.5 * (i % 7 + 1), (i % 9 + 1) * 2.5 * (i % 7 + 1), "abc"[i % 3]) for i in range(120)]
    real = frame(spark, "rid long, quantity long, unit_price double, total double, status string", *rows)
    fake = real.select((F.col("rid") + 1000).alias("rid"), "quantity", (F.col("unit_price") * 1.3).alias("unit_price"), F.lit(7.0).alias("total"), "status")
    scores = {r["metric"]: r["score"] for r in lifecycle.evaluate(real, fake, "rid").collect()}
    assert set(scores) == {"statistical", "correlation", "ml_utility", "text", "referential", "privacy"} and scores["text"] is None
    best, table = lifecycle.improve(real, fake, "rid", (0.08,))
    assert best.count() == 120 and {r["candidate"] for r in table.collect()} == {"baseline", "ks_0.08"}
    _, attempts = lifecycle.autotune(real, "rid", 100)
    assert 1 <= len(attempts) <= 3


def test_metadata(spark):
    ts = lambda h: datetime(2026, 1, 1, h)
    df = frame(spark, "i long, k long, t timestamp", (1, 1, ts(1)), (2, 1, ts(3)), (3, 1, ts(4)), (4, 2, ts(1)))
    got = {(r["id"], r["peer_id"], r["gap_seconds"]) for r in metadata.nearest_peer(df, "k", "t", "i").collect()}
    assert got == {(1, 2, 7200), (2, 3, 3600), (3, 2, 3600)}
    weak = metadata.weak_metrics(frame(spark, "metric string, score double", ("statistical", 74.0), ("correlation", 71.0)))
    assert column(weak, "metric") == ["statistical"]


def test_expressions(spark):
    df = frame(spark, "s string", "CUST-0042x7", "none", " 1e3 ", None, "inf")
    assert column(df.select(exprs.last_number("s").alias("v")), "v") == [7, None, 3, None, None]
    assert column(df.select(exprs.text_or_null("s").alias("v")), "v") == ["CUST-0042x7", None, "1e3", None, "inf"]
    assert column(df.select(exprs.number("s").alias("v")), "v") == [None, None, 1000.0, None, None]
    assert column(frame(spark, "s string", "A9x-4F2").select(exprs.signature("s").alias("v")), "v") == ["UDL-DUD"]


def test_sketched_profile(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    a, b = (profile.numeric(df, exact=e).first() for e in (True, False))
    assert a["distinct_count"] == 1000 and a["median_value"] == 499.5 and abs(b["median_value"] - 499.5) < 5 and abs(b["distinct_count"] - 1000) < 200


def test_shapes(spark):
    from weftline.operators import shape

    df = frame(spark, "oid long, flag long, x double, note string", *[(i, i % 3, i / 4, f"n{i}") for i in range(60)])
    assert dict(shape.few_valued_as_text(df).dtypes)["flag"] == "string" and dict(shape.few_valued_as_text(df).dtypes)["oid"] == "bigint"
    assert shape.model_columns(df, {"note": "llm", "flag": "remove"}).columns == ["oid", "x"]
    assert shape.training_frame(df, ["oid"], [], ["x"], ["note"]).columns == ["flag"] and shape.training_frame(df, df.columns, [], [], []).columns == df.columns
    made = df.select("oid", (F.col("flag") + 0.3).alias("flag"), (F.col("x") + 0.001).alias("x"), "note")
    assert dict(shape.restored(made, df).dtypes)["flag"] == "bigint" and shape.restored(made, df).exceptAll(df).count() == 0
    assert shape.synthetic_problems(df, df, 60, ["oid"]) == [] and shape.synthetic_problems(df.drop("x"), df, 61, ["flag"]) == ["60 rows, not 61", "columns differ", "flag repeats"]
    assert shape.is_ascending(df, "oid", ["oid"]).first()["ascending"] and not shape.is_ascending(df, "flag", ["oid"]).first()["ascending"]
    split = df.withColumn("g", F.when(F.col("oid") % 2 == 0, "a").otherwise("b")).unionByName(df.withColumn("g", F.when(F.col("oid") % 2 == 0, "a").otherwise("b")))
    assert shape.divergent_column(split, ["g"], ["x"]) is None
    apart = split.withColumn("x", F.when(F.col("g") == "a", F.col("x") + 100).otherwise(F.col("x")))
    assert shape.divergent_column(apart, ["g"], ["x"]) == "g"
    table = shape.analyse_table(df.select(F.col("oid").alias("item_id"), "x", F.concat(F.lit("Item "), F.col("oid").cast("string")).alias("name")))
    assert (table["ids"], table["functions"], table["decimals"]) == (["item_id"], ["name"], {"x": 2})
    summary = shape.preprocessing_summary(df, df.drop("note").withColumn("new", F.lit(1)), {"note": "remove", "x": "keep"})
    assert summary["added"] == ["new"] and summary["removed"] == ["note"] and summary["actions"] == {"remove": 1, "keep": 1}


def test_rows_without_a_number_keep_their_place(spark):
    real = frame(spark, "v double", *[float(i) for i in range(100)])
    made = frame(spark, "k long, v double", *[(i, None if i % 4 == 0 else i * 7.0) for i in range(80)])
    out = repair.quantile_map(real, made, "v", ["k"]).collect()
    assert len(out) == 80 and {r["k"] for r in out if r["v"] is None} == set(range(0, 80, 4))
    got = [r["v"] for r in sorted(out, key=lambda r: r["k"]) if r["v"] is not None]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 99
    matched = repair.match_marginals(real, made, ["v"], ["k"])
    assert matched.count() == 80 and matched.filter("v is null").count() == 20
    whole = frame(spark, "k long, v string", (1, "x"), (2, "5"), (3, None))
    assert repair.quantile_map(real, whole, "v", ["k"]).count() == 3


def test_rows_of_no_class_are_drawn(spark):
    df = frame(spark, "k long, c string", *[(i, None if i % 2 else "a") for i in range(1000)])
    out = repair.weighted_resample(df, frame(spark, "value string, weight double", ("a", 3.0)), "c", 1000, ["k"])
    drawn = {r["c"]: r["count"] for r in out.groupBy("c").count().collect()}
    assert out.count() == 1000 and abs(drawn[None] - 250) <= 40 and drawn[None] + drawn["a"] == 1000


def test_sample_has_different_rows(spark):
    df = frame(spark, "a long, t string", *[(i % 20, f"text {i % 20}") for i in range(6000)]).repartition(3)
    assert {r["a"] for r in roles.sample_rows(df, 100).collect()} == set(range(20))
    many = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("t"))
    one, two = (sorted(r["id"] for r in roles.sample_rows(x, 50).collect()) for x in (many.repartition(7), many.orderBy(F.desc("id"))))
    assert one == two and len(one) == 50
    assert roles.sample_rows(many.limit(0), 50).count() == 0


def test_patterns_do_not_follow_the_order_of_files(spark):
    mails = spark.range(500).select(F.when(F.col("id") < 120, F.lit("no mail at all")).otherwise(F.concat(F.lit("a"), "id", F.lit("@example.org"))).alias("m"))
    answers = {profile.patterns(x).first()["email"] for x in (mails.orderBy("id"), mails.orderBy(F.desc("id")), mails.repartition(5))}
    assert answers == {True}


def test_split_marks_exactly_so_many(spark):
    df = spark.range(30_000).withColumn("v", F.col("id") % 7)
    out = repair.train_test_split(df, ["id"], 0.2)
    assert out.count() == 30_000 and out.filter("is_test").count() == 6000
    ranked = df.withColumn("h", exprs.md5_order("id")).orderBy("h", "id").limit(6000)
    assert out.filter("is_test").select("id").exceptAll(ranked.select("id")).isEmpty()
    # a bracket that misses is widened, and equal rows are told apart
    narrow = repair.mark_first(df.withColumn("h", exprs.md5_order("id")), ["h", "id"], 137, "first", slack=1e-9)
    assert narrow.filter("first").count() == 137
    twins = repair.train_test_split(spark.range(1000).select((F.col("id") % 3).alias("k")), ["k"], 0.5)
    assert twins.count() == 1000 and twins.filter("is_test").count() == 500
    nulls = repair.train_test_split(frame(spark, "k string", None, None, "a", "b"), ["k"], 0.25)
    assert nulls.filter("is_test").count() == 1
    assert repair.train_test_split(df.limit(0), ["id"]).count() == 0
    assert repair.train_test_split(df.limit(5), ["id"], 1.0).filter("is_test").count() == 5


def test_split_does_not_shuffle_rows(spark):
    out = repair.train_test_split(spark.range(5000).withColumn("wide", F.repeat(F.lit("x"), 50)), ["id"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
