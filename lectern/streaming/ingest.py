"""Streaming ingest of a folder.  Ids are content hashes, so writing a document again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources.detect import detected
from lectern.sources.reader import frames, read_rows

FILES = "path string, modificationTime timestamp, length long, content binary"


def source(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").withColumn("format", detected("name", "content"))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parse new files and append their frames as Parquet tables below ``out``, a folder for each batch and table.

    A batch that is run again after a failure overwrites its own folders, so results are exactly once.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = read_rows(batch).persist()
        f = frames(rows)
        for name in ("docs", "elements", "cells", "pages"):
            getattr(f, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        rows.unpersist()

    writer = source(spark, path).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
