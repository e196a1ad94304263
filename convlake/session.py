"""What jobs need from the session that runs them."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: How many bytes of rows a task hands to Python at a time; a worker holds two such batches, and Spark's own bound is 64 MB.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, for jobs that run Python in tasks.

    Once for each Spark context; Spark's own file server does the copying.
    """
    context = spark.sparkContext
    if getattr(context, "_convlake_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='convlake-')}/convlake", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._convlake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without naming one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="convlake-")).rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by ``BATCH``, unless the session has a bound of its own.

    Batches are cut when a job runs, so the session keeps the setting.
    """
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def byte_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows and about ``size`` bytes at most; a single longer row is a slice."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n
    pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it holds
