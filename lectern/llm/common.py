"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """Index of the column called exactly ``name``, or else of the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    near = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(near) != 1:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return near[0]


def pick(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """Select ``new=(old, type)`` by position.

    Extra columns, even ones whose names clash with the wanted ones but for case, cannot make a
    reference ambiguous because every column is renamed before any is referred to.
    """
    flat = df.toDF(*(f"_p{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"_p{position(df, old)}").cast(kind).alias(new) for new, (old, kind) in wanted.items()))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a documents table."""
    return pick(df, doc_id=(id_col, "long"), text=(text_col, "string"))


def crc32_text(col: str | Column) -> Column:
    """Unsigned CRC-32 of a value's text in UTF-8."""
    return F.crc32(F.encode(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), "UTF-8"))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; only where none is named and all runs on one machine, a folder of it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lectern-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: later steps neither repeat the work before nor lose it with an executor.

    The files go with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set, else with the folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``cut``; of a table of narrow rows that has ``most`` at most, one partition, which needs no exchange after that."""
    out = cut(df)
    return out.coalesce(1) if out.count() <= most else out


def near(df: DataFrame, most: int = 1 << 16) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def trim() -> None:
    """Give memory back that the C library holds in reserve, where it can."""
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, giving memory that Arrow holds in reserve back after each batch: workers live on from task to task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(batches):
            yield made
            del made
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return wrapped


def batches(spark: SparkSession, size: str = "4m") -> None:
    """Bytes of text that go to a worker at a time: by number of rows alone, a batch of long texts has no bound.

    Operators that take out copies within a batch ask for larger ones.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
