"""Helpers shared by the operators: Arrow batches of texts, hash splits, filters by key, clean-up of written tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.session import cut  # noqa: F401  (operators take it from here)


PIECE_BYTES = 1 << 20


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


class _ByValue:
    def __init__(self, value):
        self.value = value

    def __reduce__(self):
        return cloudpickle.loads, (cloudpickle.dumps(self.value),)


def shared(spark: SparkSession, value):
    """Broadcast an object together with its class, so workers need not have the package.

    A worker unpacks it once, so what the object remembers lasts from task to task.
    """
    return spark.sparkContext.broadcast(_ByValue(value))


def widened(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` with further columns behind it."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items())])


def drop_tables(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        jvm = spark.sparkContext._jvm
        for name in frame.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def batch_pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``limit`` text bytes, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task of ``mapInArrow`` that hands its free memory back when it ends.

    Workers live on from task to task, and Arrow and the C library keep what a task has freed, so an
    executor would hold the most that each of its workers has ever used.
    """

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def give_back() -> None:
    """Free memory of this process goes back to the system, as far as its libraries can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def keep_matching(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in ``kept``, one row of each key.

    Both steps need the same partitioning and order, so the rows move once.
    """
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys)
