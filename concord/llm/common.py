"""What the operators share: cutting lineage, sizing partitions, and reading text batches."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.plans import storage
from concord.plans.storage import shared_dir

__all__ = ["shared_dir"]

TARGET_BYTES = 32 << 20


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some megabytes: rows hold whole texts, so the usual number of rows may be any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at a task's end what it has freed goes back to the system: workers wait for the next task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def cut(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """The table written into the shared folder and read again, in row groups that workers can hold."""
    return storage.cut(df, name, 16, small)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame, target: int = TARGET_BYTES) -> int:
    """As many partitions as the session asks for, or more if they would exceed the target."""
    small_batches(df.sparkSession)
    size = input_bytes(df)
    known = size < 1 << 55  # a plan without statistics says the largest number
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / target) if known else 1)


def smallest(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The ``limit`` rows whose column has the smallest hash; the sort sees little more than those."""
    n = df.count()
    if n > limit:
        share = (1.1 * limit + 1000) / n
        few = df.where((F.pmod(F.xxhash64(column), F.lit(1 << 40)) < int(share * (1 << 40))) | F.lit(share >= 1))
        df = few.orderBy(F.pmod(F.xxhash64(column), F.lit(1 << 40)), column).limit(limit)
    return df


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


PIECE = 1_000_000  # bytes of text that are worked on at a time: under a power of two, also with a byte more a row


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most this many bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def documents(df: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), *[df[c] for c in more])


def free_name(df: DataFrame, name: str) -> str:
    """A column name the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append(df: DataFrame, columns: list[str], make, ddl: str, name: str, keep: list[str] | None = None) -> DataFrame:
    """Add one struct column made by ``make(arrays of the named columns) -> pa.StructArray`` in Arrow batches; of the others, return those in ``keep``."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    where = [df.columns.index(c) for c in columns]
    kept = [k for k, c in enumerate(df.columns) if keep is None or c in keep]
    schema = StructType([df.schema.fields[k] for k in kept]).add(name, _parse_datatype_string(f"struct<{ddl}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*[arrays[k] for k in kept], make(*[arrays[k] for k in where])], [*[batch.schema.names[k] for k in kept], name])

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema)
