"""What the corpus operators share: written cut points and column handling."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch from the JVM to a worker while written() runs: batches count rows otherwise (64 MB at most), and both sides hold them.
BATCH_BYTES = 8 << 20
#: Words of every operator: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="factlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); in local mode a temporary one where none is set.

    On a cluster a folder of one machine would lose rows silently, so there the setting is required.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{_local_folder()}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/factlake/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written by written(); results that still read it must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of ``most`` bytes (or one row) in plans that run inside; a lower setting stays, and the session's returns afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if 0 < now <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so that a lost executor costs reads, not recomputation.

    Each call writes to a folder of its own, under one folder for each application, so that what a run has written can be removed (clear()) when its results are.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, *names: str) -> DataFrame:
    """Columns ``names`` of df, and the whole row as ``_row``: so own columns can't clash with those that an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names], F.struct("*").alias("_row"))


def restored(df: DataFrame, columns: list[str], **changed: Column) -> list[Column]:
    """The columns of a carried row, some of them changed."""
    return [changed.get(c, F.col("_row").getField(c)).alias(c) for c in columns]


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, a null one as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: int = 0, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a text column holds about ``size`` bytes in each (a longer text comes alone)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
        release()


@cache
def _allocator():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Gives memory that a worker has freed back to the machine, where it counts against the executor."""
    pa.default_memory_pool().release_unused()
    _allocator()(0)


def lean(group: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group's table that releases memory after each group."""

    def run(rows: pa.Table) -> pa.Table:
        out = group(rows)
        release()
        return out

    return run
