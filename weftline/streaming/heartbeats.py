"""A watch over runs that give signs of life: one that falls silent is told once, and told again when it is back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.functions.storage import shared_folder

CHANGES = "run string, beat timestamp, status string"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Watch(StatefulProcessor):
    """Keeps a run's last sign of life and one timer, which is moved with every later sign."""

    def __init__(self, minutes: int):
        self.span = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "beat long, due long, stale boolean")

    def told(self, run: str, beat: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"run": [run], "beat": [pd.Timestamp(beat, unit="us")], "status": [status]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["beat"].max()) for part in rows)
        known = self.last.get() if self.last.exists() else None
        if known is not None and known[0] >= newest:
            return
        if known is not None and not known[2]:
            self.handle.deleteTimer(known[1])
        due = newest // 1000 + self.span
        # a sign that is itself too old by now wakes no one; its timer fires at once
        self.handle.registerTimer(due)
        late = due <= timerValues.getCurrentWatermarkInMs()
        self.last.update((newest, due, False))
        if known is not None and known[2] and not late:
            yield self.told(key[0], newest, "alive")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        beat, due, stale = self.last.get()
        if stale or expiredTimerInfo.getExpiryTimeInMs() != due:
            return
        self.last.update((beat, due, True))
        yield self.told(key[0], beat, "stale")

    def close(self) -> None:
        pass


def watched(beats: DataFrame, run: str, beat: str, minutes: int, late: str = "0 seconds") -> DataFrame:
    """(run, beat, status): ``stale`` once a run of a stream has given no sign for so many minutes of event time, ``alive`` when it does again.

    State is one row a run. Rows without a run or a time are left out, and so are signs that come
    more than ``late`` behind the newest of all.
    """
    timed = beats.select(F.col(run).cast("string").alias("run"), F.col(beat).cast("timestamp").alias("at")).filter("run is not null and at is not null").withWatermark("at", late)
    rows = timed.select("run", "at", F.unix_micros("at").alias("beat"))
    return rows.groupBy("run").transformWithStateInPandas(Watch(minutes), CHANGES, "append", "EventTime")


def run_watch(spark: SparkSession, beats: DataFrame, run: str, beat: str, minutes: int, path: str, late: str = "0 seconds"):
    """Starts the watch over what has come so far; its changes go to a Parquet folder, and the same path goes on later."""
    old = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)  # timers live in RocksDB
    try:
        return watched(beats, run, beat, minutes, late).writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stale_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, beat) of the runs whose last change is that they fell silent."""
    newest = Window.partitionBy("run").orderBy(F.desc("beat"), F.desc("status"))
    changes = spark.read.schema(CHANGES).parquet(f"{path}/changes")
    return changes.withColumn("_p", F.row_number().over(newest)).filter("_p = 1 and status = 'stale'").select("run", "beat")


def stale_events(spark: SparkSession, sf_dir: str, minutes: int = 24 * 60) -> DataFrame:
    """Users as runs: who gave no event for so long before the last event of all, found by the watch."""
    schema, path = spark.read.parquet(f"{sf_dir}/events.parquet").schema, f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    run_watch(spark, stream, "user_id", "ts", minutes, path).awaitTermination()
    return stale_runs(spark, path)
