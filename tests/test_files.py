"""Readers, sinks and streams."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftline.operators import generate
from weftline.sources import readers, sinks
from weftline.streaming import batches


def write(tmp_path, name, data, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(data.encode(encoding))
    return f"file://{p}"


def test_spaced_header(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id, name, city, x, y, z, w\n1, Ann, Ulm, 1, 2, 3, 4\n2, Bob, Bonn, 5, 6, 7, 8\n")
    df = readers.read_table(spark, path)
    assert df.columns == ["id", "name", "city", "x", "y", "z", "w"] and df.count() == 2 and df.first()["city"] == "Ulm"


def test_wrapped_rows(spark, tmp_path):
    path = write(tmp_path, "b.csv", '"a,b,c,d,e,f,g"\n"1,2,3,4,5,6,7"\n"8,""x, y"",3,4,5,6,7"\n')
    df = readers.read_table(spark, path)
    assert len(df.columns) == 7 and sorted(str(r["b"]) for r in df.collect()) == ["2", "x, y"]


@pytest.mark.parametrize("mark", [";", "\t", "|"])
def test_delimiters(spark, tmp_path, mark):
    path = write(tmp_path, "c.csv", mark.join("abc") + "\n" + mark.join("123") + "\n")
    assert readers.read_table(spark, path).columns == ["a", "b", "c"]


def test_encodings(spark, tmp_path):
    for name, encoding in (("u.csv", "utf-8-sig"), ("l.csv", "latin-1")):
        df = readers.read_table(spark, write(tmp_path, name, "größe,n\nüber,1\n", encoding))
        assert df.columns == ["größe", "n"] and df.first()["größe"] == "über"


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_table(spark, write(tmp_path, "s.csv", "only\n1\n"))
    for name, size in (("x.exe", 5), ("a.csv", 0), ("", 5), ("a.csv", 2**50)):
        with pytest.raises(ValueError):
            readers.check_upload(name, size)
    with pytest.raises(ValueError):
        readers.preview(spark.range(3), 51)
    with pytest.raises(AnalysisException):
        readers.read_excel(spark, "file:///nowhere.xlsx")


def test_sinks(spark, tmp_path):
    out = sinks.save_generated(spark.range(7), f"file://{tmp_path}", "orders", "copula")
    assert out["rows"] == 7 and spark.read.parquet(out["path"]).count() == 7
    manifest = sinks.save_tables({"a": spark.range(2), "b": spark.range(3)}, f"file://{tmp_path}/all")
    assert {(r["table_name"], r["rows"]) for r in manifest.collect()} == {("a", 2), ("b", 3)}
    rows = spark.createDataFrame([(float("nan"), "x")], "v double, s string")
    assert sinks.finite_json(rows).first()["json"] == '{"s":"x"}'
    assert "&lt;b&gt;" in sinks.html_report("t", spark.createDataFrame([("<b>",)], "metric string"))


def test_checkpointed_generation_resumes(spark, tmp_path):
    model = generate.GaussianCopula().fit(spark.range(50).select(F.col("id").cast("double").alias("x")))
    path = f"file://{tmp_path}/ckpt"
    sinks.append_batch(model.generate(spark, 25, 0), path, 0)
    assert generate.generate_checkpointed(model, spark, 60, path, 25).count() == 60


def test_stream_of_valid_rows(spark, tmp_path):
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    rule = [{"rule_type": "non_negative", "column": "v"}]
    for part in ((1, -2, 3), (4, -5)):
        spark.createDataFrame([(v,) for v in part], "v long").write.mode("append").parquet(source)
        batches.validate_stream(spark, source, target, state, rule).awaitTermination()
    assert sorted(r["v"] for r in spark.read.parquet(target).collect()) == [1, 3, 4]
