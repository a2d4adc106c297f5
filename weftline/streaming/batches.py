"""Structured Streaming: resumable micro-batches and windowed profiles of an event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.functions.storage import shared_folder

from weftline.operators import rules


def validate_stream(spark: SparkSession, source: str, target: str, checkpoint: str, row_rules: list[dict], files_per_batch: int = 4):
    """Copy the valid rows of a growing Parquet folder; stops when it has caught up, goes on where it stopped."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    valid = rules.valid_rows(stream, row_rules)
    return valid.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows.

    In an endless stream, rows later than ``late`` are left out and closed windows leave the
    state. With None nothing is left out, and the state holds every window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    out = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def windowed_counts(spark: SparkSession, sf_dir: str, files_per_batch: int = 4) -> DataFrame:
    """The event table as a stream that ends: every batch writes the windows it changed, the newest of each count.

    A batch's folder is replaced if the batch runs again, so a restart does no harm.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parquet*")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = event_windows(stream, late=None).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    newest = Window.partitionBy("window_start", "event_type").orderBy(F.desc("batch"))
    return spark.read.parquet(f"{folder}/out").withColumn("_p", F.row_number().over(newest)).filter("_p = 1").drop("_p", "batch")
