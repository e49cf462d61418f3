"""Cuts long plans and spreads small inputs: what several arms read is computed once, by all cores."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of a batch that goes to a Python worker, and so of the worker's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's batch bounds to BATCH where they are higher; they stay so for all frames."""
    for key, most in BATCH.items():
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns memory that is free, but still held by the allocators of this worker, to the system.

    Workers are kept between tasks; without this each would hold what its largest task ever took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Documents that a task holds at once.
BATCH_DOCS = 256


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH_DOCS):
            yield batch.slice(begin, BATCH_DOCS)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    A temporary one serves only where none is set and driver and tasks are one process; on a cluster
    that is an error, because executors could not read each other's local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again with its schema."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The frame from a reliable checkpoint, so that later plans are short and survive lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the scan has no more splits than cores; larger inputs stay as they are.

    For scans only: of those Spark knows the number of splits without running anything.  A Parquet file
    is split by row groups, so a small table may come in one part whatever its bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() <= cores else df
