"""What the operators of this folder share: staging, shipping code, word splitting, batching."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annalist.sources import shared, workers

# Words are runs of anything but the six ASCII white-space characters. ``bytes.split()``
# cuts at exactly these, and ``bytes.lower()`` lowers exactly A-Z.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"

# Rows of text handled at once by a task; keeps memory flat when texts are long.
TEXT_BYTES = 2_500_000

# What a worker keeps from task to task, and how to let go of it. Workers outlive stages, so
# the next operator that runs in one frees what the last has kept.
KEPT: dict[str, Callable[[], None]] = {}


# Bytes of a batch that Spark sends to a Python worker, at most (one row at least). Both sides
# hold a batch or two beside what they make of it.
BATCH_BYTES = 8_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the workers, and let no batch on its way there be large."""
    workers.ship(spark)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if size > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends in stored files."""
    spark = df.sparkSession
    path = shared.folder(spark, label)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more."""
    for df in staged:
        shared.remove(df.sparkSession, df.stage_path)


def named(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, whatever else the table has."""
    return docs.select(named(key).alias("doc_id"), named(text).alias("text"))


def plain_names(docs: DataFrame) -> list[str]:
    """Names for the columns of a frame that any function of Spark takes: c0, c1 and so on."""
    return [f"c{n}" for n in range(len(docs.columns))]


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo a number; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", keep: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``TEXT_BYTES`` of text (one row at least)."""
    for name, free in KEPT.items():
        if name != keep:
            free()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + TEXT_BYTES, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return what a task has freed to the system, since its worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


# Bytes of a frame that is sent to all executors, at most: 16 a value and what texts hold.
BROADCAST_BYTES = 64_000_000


def by_size(spark: SparkSession, df: DataFrame, most_rows: int) -> DataFrame:
    """Mark a frame of ids for broadcast if its rows and bytes prove it small; else leave Spark to shuffle."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    held = sum((F.coalesce(F.sum(x), F.lit(0)) for x in texts), F.count(F.lit(1)) * 16 * len(df.columns))
    rows, size = df.agg(F.count(F.lit(1)), held).first()
    return F.broadcast(df) if rows <= most_rows and size <= BROADCAST_BYTES else df


def publish(path: str, data: bytes) -> None:
    """Write a file in the shared folder in one step, so that a retried task cannot tear it."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    attempt = f"{place}.{os.getpid()}-{os.urandom(6).hex()}"
    with system.open_output_stream(attempt) as out:
        out.write(data)
    system.move(attempt, place)
