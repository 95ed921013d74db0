"""What the operators share: the shared folder, lineage cuts and access to files in it."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: ASCII white space separates, anything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``, or (in local mode only) a new temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = tempfile.mkdtemp(prefix="loomsearch-")
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later stages neither recompute it nor depend on an executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that no later stage reads."""
    for df in frames:
        path = getattr(df, "loom_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds, as a file of the shared folder: unlike createDataFrame this starts no Python workers."""
    path = fresh_path(spark, "rows")
    names = [c.split()[0] for c in schema.split(", ")]
    body = "".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows.json")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(body.encode()))
    out.close()
    return spark.read.schema(schema).json(path)


def open_fs(uri: str):
    """(pyarrow file system, path) for a URI of the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Rows of an Arrow batch: texts can be long, and a task holds a few batches in both processes.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies on a path that they share (a cluster without one uses --py-files), and keep batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root


_model: dict[object, object] = {}


def hold(key: object, make):
    """This worker's model ``key``. A worker keeps one at a time, as workers outlive the stages that need them."""
    if key not in _model:
        _model.clear()
        give_back()
        _model[key] = make()
    return _model[key]


def _lean() -> None:
    """Let this process return large freed arrays to the system at once: glibc keeps them in the heap otherwise, Arrow's own pool in its segments."""
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 16 << 20), (-1, 32 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(option, value)
        pa.set_memory_pool(pa.system_memory_pool())
    except (AttributeError, OSError):  # not glibc
        pass


_tuned: list[int] = []


def give_back() -> None:
    """Return what this process has freed to the system: a worker waits for its next task beside others and the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """A function of a task's batches that gives freed memory back when the task ends."""

    def tidied(batches):
        if os.getpid() not in _tuned:
            _lean()
            _tuned[:] = [os.getpid()]
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
