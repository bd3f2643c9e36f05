"""Intermediate tables in the folder shared by the driver and the executors.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost
executor then costs a re-read, not a recomputation.  Where the session names no
such folder, one is made and set in local mode, where all threads share the machine;
on a cluster that would lose data, so it is refused.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: its setting, or what ``setCheckpointDir`` was given."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and re.fullmatch(r"local(\[.*\])?", context.master):
        folder = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        context.setCheckpointDir(folder)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def save(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` into the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`save`."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans no longer in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; behind it a worker, which waits for more tasks, gives free memory back."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped
