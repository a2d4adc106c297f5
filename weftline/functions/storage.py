"""Settling intermediate results in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A session on one machine that names none (as in tests) gets a temporary folder; on a
    cluster, where that would be another disk on each machine, it is an error.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir():
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
