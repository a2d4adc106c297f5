"""Generation as a stream: pause, resume, extend, cancel; metrics observed while writing."""

import uuid

import pytest
from pyspark.sql import functions as F

from weftline.operators import clean, generate
from weftline.sources import sinks
from weftline.streaming import generation


@pytest.fixture(scope="module")
def model(spark):
    df = spark.range(400).select((F.col("id") % 17).alias("n"), (F.col("id") * 0.5).alias("x"), F.concat(F.lit("k"), F.col("id") % 5).alias("c"))
    return generate.GaussianCopula(seed=3, max_categories=3).fit(df)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_paused_and_resumed_is_one_run(spark, tmp_path, model):
    path, told = str(tmp_path / "run"), []
    assert generation.done_numbers(spark, path) == 0
    first = generation.generate_stream(model, spark, 70, path, batch=30)
    assert first.count() == 70 and generation.done_numbers(spark, path) == 70
    whole = generation.generate_stream(model, spark, 200, path, batch=45, progress=lambda *x: told.append(x))
    assert told == [(200, 200)]
    assert rows_of(whole) == rows_of(model.generate(spark, 200))
    assert rows_of(generation.generate_stream(model, spark, 200, path)) == rows_of(whole)  # nothing left to do
    generation.cancel(spark, path)
    assert generation.done_numbers(spark, path) == 0


def test_stopped_in_the_middle(spark, tmp_path, model):
    path = str(tmp_path / "stopped")
    query = generation.start_generation(model, spark, 4000, path, batch=100)
    while not any(p["numInputRows"] for p in query.recentProgress):
        assert query.exception() is None
    query.stop()
    done = generation.done_numbers(spark, path)
    assert 0 < done <= 4000
    assert generation.generate_stream(model, spark, 4000, path, batch=2000).count() == 4000
    assert rows_of(generation.generated(spark, path)) == rows_of(model.generate(spark, 4000))


def test_rules_and_models_that_cannot(spark, tmp_path, model):
    rule = [{"rule_type": "range", "column": "n", "min": 8}]
    made = generation.generate_stream(model, spark, 100, str(tmp_path / "rules"), row_rules=rule)
    assert rows_of(made) == rows_of(model.generate(spark, 100).filter("n >= 8"))
    with pytest.raises(TypeError):
        generation.start_generation(generate.ProvidedText("t", lambda n, e: "[]"), spark, 5, str(tmp_path / "no"))


def test_checkpointed_batches_give_the_first_rows(spark, tmp_path, model):
    path, told = str(tmp_path / "batches"), []
    assert generate.generate_checkpointed(model, spark, 95, path, 30, progress=lambda *x: told.append(x)).count() == 95
    assert told == [(30, 95), (60, 95), (90, 95), (95, 95)]
    some = generate.generate_checkpointed(model, spark, 50, path, 30)
    assert some.count() == 50 and not set(rows_of(some)) - set(rows_of(model.generate(spark, 95)))
    assert generate.generate_checkpointed(model, spark, 60, path, 30).count() == 60


def jobs_of(spark, run):
    context = spark.sparkContext
    name = uuid.uuid4().hex
    context.setJobGroup(name, name)
    out = run()
    jobs = context.statusTracker().getJobIdsForGroup(name)
    context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(jobs)


def test_a_write_is_one_job(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    saved, jobs = jobs_of(spark, lambda: sinks.save_generated(df, str(tmp_path), "t", "m"))
    assert saved["rows"] == 1000 and jobs == 1
    n, jobs = jobs_of(spark, lambda: sinks.append_batch(df, str(tmp_path / "b"), 0))
    assert n == 1000 and jobs == 1
    assert {r["table_name"]: r["rows"] for r in sinks.save_tables({"a": df, "b": df.limit(0)}, str(tmp_path / "all")).collect()} == {"a": 1000, "b": 0}


def test_preprocessing_is_checked_as_it_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, None), (3, 4.0, "b")] * 5, "k long, v double, c string")
    assert clean.preprocess_to(df, str(tmp_path / "out")) == 15
    written, plain = spark.read.parquet(str(tmp_path / "out")), clean.preprocess(df)
    assert written.columns == plain.columns and rows_of(written) == rows_of(plain)
    assert clean.output_problems(plain, 15) == []
    assert clean.told_problems({"_n": 3, "null a": 0, "infinite b": 2}, 4) == ["3 rows, not 4", "infinite b"]
    with pytest.raises(ValueError):
        clean.preprocess_to(df.limit(0), str(tmp_path / "none"))
    assert not sinks.exists(spark, str(tmp_path / "none"))
