"""Generation as a stream of row numbers that can be paused, resumed, extended and cancelled.

A row depends on the model's seed and its number only, and the stream's checkpoint holds the
next number. A run that stops, for whatever reason, goes on where its last whole micro-batch
ended; the file sink's log makes each batch count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import rules
from weftline.sources import numbers, sinks

#: Runs of numbers for each task of a micro-batch.
RUNS_A_TASK = 2


def row_numbers(spark: SparkSession, rows: int, batch: int) -> DataFrame:
    """(id): a stream of the numbers from 0 to ``rows`` - 1."""
    spark.dataSource.register(numbers.RowNumbers)
    tasks = RUNS_A_TASK * spark.sparkContext.defaultParallelism
    runs = spark.readStream.format(numbers.NAME).options(rows=rows, batch=batch, run=max(1, -(-batch // tasks))).load()
    return runs.repartition(spark.sparkContext.defaultParallelism).select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("id"))


def start_generation(model, spark: SparkSession, rows: int, path: str, batch: int = 100_000, row_rules: list[dict] | None = None):
    """The running query that writes ``rows`` rows of a model below ``path``; rows that break the rules are left out.

    Stop it to pause; start it again with the same path, and as many rows or more, to go on.
    ``made`` in its progress has the rows of each micro-batch.
    """
    if not getattr(model, "streams", False):
        raise TypeError(f"{type(model).__name__} does not make a row from its number alone")
    out = model.of_numbers(row_numbers(spark, rows, batch))
    kept = rules.valid_rows(out, row_rules or []).observe("made", F.count("*").alias("rows"))
    return kept.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").start()


def generate_stream(model, spark: SparkSession, rows: int, path: str, batch: int = 100_000, row_rules: list[dict] | None = None, progress=None) -> DataFrame:
    """All rows up to number ``rows``, what an earlier run with this path made included; ``progress`` is told (numbers done, rows wanted) once at the end of this run."""
    query = start_generation(model, spark, rows, path, batch, row_rules)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    if progress:
        progress(done_numbers(spark, path), rows)
    return generated(spark, path)


def generated(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all whole micro-batches so far."""
    return spark.read.parquet(f"{path}/rows")


def done_numbers(spark: SparkSession, path: str) -> int:
    """How many numbers are done: the offset of the last micro-batch that was committed."""
    import json

    if not sinks.exists(spark, f"{path}/state/commits"):
        return 0
    place = spark._jvm.org.apache.hadoop.fs.Path
    folder = place(f"{path}/state/commits")
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    last = max((int(n) for n in names if n.isdigit()), default=None)
    if last is None:
        return 0
    lines = [r["value"] for r in spark.read.text(f"{path}/state/offsets/{last}").collect()]
    return next(json.loads(x)["row"] for x in reversed(lines) if x.startswith('{"row"'))


def cancel(spark: SparkSession, path: str) -> None:
    """Forget a stopped run and what it made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
