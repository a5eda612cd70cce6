"""Tables written to the folder that the cluster names in spark.checkpoint.dir, and read again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only where none is named and all runs on one machine, a folder of it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lectern-checkpoints"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, for steps that are repeated.

    Files go with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set, else with the folder,
    which Spark names anew for each application.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, written once as Parquet, a folder for each value of ``by``; what is read of them is pruned to it."""
    path = f"{shared_dir(df.sparkSession)}/lectern-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
