"""Helpers shared by the operators: memory given back by tasks, folders, and Arrow batch slicing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..tables import cut as saved
from ..tables import scratch, sent  # noqa: F401  the operators take them from here
from .tokens import trim_caches


def resting(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give back memory when a task ends. Spark keeps idle Python workers, as many as ever ran at once, and hands
    each on to other stages; what they hold would add up next to the stages at work."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim_caches()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return run


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table made by saved(); nothing may read it afterwards."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        remove(spark, folder)


def make_folder(spark: SparkSession, path: str) -> None:
    """So that a reader finds an empty folder where nothing was written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about `limit` bytes of text; one long text makes a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.diff(offsets_of(batch.column(column)))
    total, first = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(first, i - first)
            total, first = 0, i
        total += size
    yield batch.slice(first)


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array (nulls have no bytes)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind) if texts.buffers()[1] is not None else np.zeros(1, kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and each text's offsets in them."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
