"""Helpers shared by the text operators: the shared folder, Arrow text buffers, hashing."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.storage import fixed as checkpointed
from factloom.storage import shared_folder

__all__ = ["binary_parts", "checkpointed", "kept", "make_room", "mix64", "release", "scratch", "shared_folder", "slices", "small_batches", "stored"]

#: Lists of the folders that were made since each open ``scratch`` began.
_OPEN: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once into a Parquet table in the shared folder and read that."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Folders made inside are deleted at the end, but for those taken out of the list it gives."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


#: Bytes of an Arrow batch where rows hold whole texts and the result is made at once.
BATCH_BYTES = "4m"


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, rows go to Python in smaller batches than the session says; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: The functions whose results a worker keeps from task to task, by operator.
_KEPT: dict[str, list] = {}


def kept(operator: str, size: int):
    """As ``lru_cache``; what is kept goes when a worker begins to serve another operator."""

    def wrap(f):
        f = lru_cache(size)(f)
        _KEPT.setdefault(operator, []).append(f)
        return f

    return wrap


def make_room(operator: str) -> None:
    """To be called where a task of ``operator`` begins: workers serve one operator after another."""
    for name, functions in _KEPT.items():
        if name != operator:
            for f in functions:
                f.cache_clear()
    release()


def release() -> None:
    """Give memory that is free again back to the system; workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def binary_parts(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """A binary or string array as one buffer and ``n + 1`` offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide = np.int32
    else:
        wide = np.int64
    n = len(column)
    if n == 0:
        return memoryview(b""), np.zeros(1, np.int64)
    if column.null_count:
        blank = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(blank)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    return memoryview(data) if data is not None else memoryview(b""), at


def slices(at: np.ndarray, most: int):
    """Row ranges ``(i, j)`` that hold at most ``most`` bytes, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published murmur3 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
