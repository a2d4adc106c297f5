"""Forests on grouped rows against forests on rows, and no forest that is not asked for."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from weftline.operators import ml


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(6000).withColumns({"x": F.pmod(F.xxhash64("id"), F.lit(900)).cast("double"), "kind": F.pmod(F.hash("id"), F.lit(4)).cast("string"), "noise": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("string")})
    return df.withColumns({"label": F.when(F.col("x") + 100 * F.col("kind").cast("int") > 600, "high").otherwise("low"), "y": F.col("x") * 2 + 300 * F.col("kind").cast("int") + F.pmod("id", F.lit(7))}).cache()


@pytest.mark.parametrize("target, columns", [("label", ["x", "kind"]), ("y", ["x", "kind"])])
def test_grouped_rows_make_the_same_forest(spark, table, monkeypatch, target, columns):
    want = ml.utility(table, table, target, ["id"], columns).first()
    monkeypatch.setattr(ml, "ROWS", 1500)
    got = ml.utility(table, table, target, ["id"], columns).first()
    assert got["status"] == want["status"] == "evaluated"
    assert (got["real_score"], got["score"]) == pytest.approx((want["real_score"], want["score"]), rel=0.1)


def test_every_row_counts_in_a_group(spark, table, monkeypatch):
    monkeypatch.setattr(ml, "ROWS", 1500)
    rows = table.select("kind", F.col("label").alias("_y"))
    one = ml.grouped(rows, ["kind"], False)
    assert one.count() < 1600 and one.groupBy("kind", "_y").agg(F.sum("_w").cast("long")).exceptAll(rows.groupBy("kind", "_y").count()).count() == 0
    mean = ml.grouped(table.select("kind", F.col("y").alias("_y")), ["kind"], True).agg(F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).first()[0]
    assert mean == pytest.approx(table.agg(F.avg("y")).first()[0])


def test_no_second_forest_if_the_first_predicts_nothing(spark, table, monkeypatch):
    fits, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, *a: fits.append(1) or fit(self, df, *a))
    assert ml.utility(table, table, "noise", ["id"], ["x", "kind"]).first()["status"] == "not_predictable" and len(fits) == 1


def test_thresholds_come_from_all_rows(spark, monkeypatch):
    """Of more rows than bins squared, Spark would draw a sample to find a forest's thresholds."""
    rows = spark.range(95_000).withColumns({"x": F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")}).withColumn("label", F.when(F.col("x") > 400, "high").otherwise("low")).cache()
    fitted, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(ml, "TREES", 3)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, *a: fitted.append((df.count(), df.agg(F.sum("_w")).first()[0] if "_w" in df.columns else df.count())) or fit(self, df, *a))
    assert ml.utility(rows, rows, "label", ["id"], ["x"]).first()["score"] == pytest.approx(100, abs=1)
    assert [n <= ml.BINS**2 for n, _ in fitted] == [True, True]
    assert fitted[0][1] == pytest.approx(76_000, rel=0.01) and fitted[1][1] == 95_000
