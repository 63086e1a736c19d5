"""Shared helpers: table access, shared scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps
from inspect import signature

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python, so that very long texts stay within a worker's memory.
ARROW_ROWS = 1024

SPACE = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of one scale directory, by any path that Spark can read."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lower the Arrow batch size where it still has Spark's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a scan of files, whose rows have a place in them; else a written copy."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema
    except AnalysisException:
        return write_table(docs, "rows")
    return docs


def row_ids(docs: DataFrame) -> Column:
    """A number for each row of ``stored`` files: its file's hash and its place in the file. It is the same in every scan,
    however Spark cuts the files, and successive within a file. The driver holds a hash of each file's name, to make sure that no
    two files' numbers meet."""
    names = sorted({re.sub("^file:/+", "file:/", f) for f in docs.inputFiles()})
    gap, salt = max((_gap(names, salt), -salt) for salt in range(4))
    meta = docs.metadataColumn("_metadata")
    name = F.concat(F.regexp_replace(meta["file_path"], "^file:/+", "file:/"), F.lit(f"#{-salt}"))
    at = meta["row_index"]
    return F.shiftright(F.xxhash64(name), 1) + F.when(at < gap, at).otherwise(F.raise_error(F.lit("a file has too many rows to number")))


def _gap(names: list[str], salt: int) -> int:
    """The least distance between two files' first numbers."""
    at = np.array([xxhash.xxh64_intdigest(f"{n}#{salt}".encode(), seed=42) for n in names], np.uint64).view(np.int64)
    return int(min([1 << 61, *np.diff(np.sort(at >> 1)).tolist()]))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; unset, which only a local session may leave it
    (tests), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lumengraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def remove_scratch(spark: SparkSession) -> int:
    """Remove all scratch tables of this driver, once no result that reads them is needed any more; how many there were."""
    gone = 0
    while _SCRATCH:
        p = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def write_table(df: DataFrame, tag: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write to shared scratch and read back: cuts the lineage at a table that outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    if compression:
        w = w.option("compression", compression)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than at its next collection of garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Spark's setting for what runs inside."""
    was = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was)


@lru_cache(maxsize=1)
def _libc():
    """The C library, told to give very large pieces of memory back at once, and others only when asked to; None where it isn't
    glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD, which else grows with what is freed
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
        return libc
    except (OSError, AttributeError):
        return None


def lean(f: Callable) -> Callable:
    """A function for Python workers, which live on for later stages, that gives back the memory it no longer needs when it ends."""
    trimmed = [0.0]

    def trim() -> None:
        if time.monotonic() - trimmed[0] > 0.5:
            pa.default_memory_pool().release_unused()
            if _libc() is not None:
                _libc().malloc_trim(0)
            trimmed[0] = time.monotonic()

    def run(*args):
        _libc()
        out = f(*args)
        if not isinstance(out, Iterator):
            trim()
            return out

        def rows():
            try:
                yield from out
            finally:
                trim()

        return rows()

    # Spark counts the arguments
    by_arguments = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    return wraps(f)(by_arguments[len(signature(f).parameters)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uri(path: str) -> str:
    """A form of a scratch path that pyarrow's file systems take."""
    return re.sub(r"^file:/+", "file:///", path)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
