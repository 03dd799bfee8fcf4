"""The session's shared folder."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a local master gets one of our own without it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir', 'file:/tmp/larkspur')}/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()
