"""What the operators of this folder share: tables, scratch space, byte streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.sources.shared import fresh

#: Words are runs of anything but blanks, in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI below spark.checkpoint.dir, which all executors share."""
    return fresh(spark, name)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing needs any more: what was made of it has been settled too."""
    import gc

    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    # the shuffle files of finished jobs go when both sides drop their plans
    gc.collect()
    spark._jvm.System.gc()


def lean_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches for whole texts: JVM and worker each hold one at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trim() -> None:
    """Give freed memory back to the system: workers live on for other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f):
    """f for applyInArrow, that leaves no freed memory behind."""

    def run(own):
        try:
            return f(own)
        finally:
            trim()

    return run


# -- byte files in the shared folder, for workers ---------------------------------------------------------------------


def put_file(uri: str, chunks) -> None:
    """Write bytes-like chunks to uri under another name first, so that a second attempt of the task never leaves half a file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as out:
        for c in chunks:
            out.write(c)
    store.move(part, path)


def map_file(uri: str):
    """A read-only memory map of uri; a store without memory maps is read into memory."""
    import pyarrow as pa
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer() if store.get_file_info(path).size else pa.py_buffer(b"")
    with store.open_input_stream(path) as f:
        return pa.py_buffer(f.read())
