"""The watch over runs against what a batch finds."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftline.streaming import heartbeats

DAY = datetime(2026, 1, 1)


def beats(spark, path, *rows):
    spark.createDataFrame([(r, DAY + timedelta(minutes=m)) for r, m in rows], "run string, at timestamp").coalesce(1).write.mode("append").parquet(path)


def watch(spark, source, path):
    stream = spark.readStream.schema("run string, at timestamp").parquet(source)
    heartbeats.run_watch(spark, stream, "run", "at", 30, path).awaitTermination()
    changes = [(r["run"], int((r["beat"] - DAY).total_seconds() // 60), r["status"]) for r in spark.read.schema(heartbeats.CHANGES).parquet(f"{path}/changes").collect()]
    return sorted(changes), {r["run"] for r in heartbeats.stale_runs(spark, path).collect()}


def test_silent_and_back(spark, tmp_path):
    source, path = str(tmp_path / "beats"), str(tmp_path / "watch")
    beats(spark, source, ("a", 0), ("b", 0), ("a", 50), (None, 3), ("c", 45), ("b", 5))
    changes, stale = watch(spark, source, path)
    assert changes == [("b", 5, "stale")] and stale == {"b"}
    beats(spark, source, ("b", 60), ("a", 70), ("c", 46))
    changes, stale = watch(spark, source, path)
    assert changes == [("b", 5, "stale"), ("b", 60, "alive")] and stale == set()
    beats(spark, source, ("d", 200))  # and the sign of c at 46 came too late for a watermark at 50
    changes, stale = watch(spark, source, path)
    assert stale == {"a", "b", "c"} and ("c", 45, "stale") in changes and changes.count(("b", 60, "stale")) == 1


def test_events_equal_the_batch(spark):
    d = "/root/testdata/sf0.001"
    last = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("ts"))
    now = last.agg(F.max("ts")).first()[0]
    want = {str(r["user_id"]) for r in last.filter(F.col("ts") < F.lit(now - timedelta(days=1))).collect()}
    assert {r["run"] for r in heartbeats.stale_events(spark, d).collect()} == want
