"""Batches between Spark and its Python workers: bounded by rows and bytes, and the memory of done ones given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch that a task sends to its worker. One row may be longer.
ROWS, BYTES = 1000, 8 << 20
#: Rows of a batch that a worker sends back.
OUT_ROWS = 1 << 16


def keep_small(spark: SparkSession) -> None:
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return what this process has freed to the system: a worker waits for its next task beside others and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
