"""A folder of their own for queries that write and read back: below the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path that the driver and all executors share; only a local session without a folder set gets one of the machine."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{folder}/{name}-{uuid.uuid4()}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder once, for tables that a query reads many times."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)
