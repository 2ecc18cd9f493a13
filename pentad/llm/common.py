"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pentad
from pentad.storage import cut, drop, shared_dir, tables_dir

# Functions sent to executors carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(pentad)

__all__ = ["LOWER", "blobs", "cut", "drop", "finite_vector", "lower_az", "main_dimension", "map_batches", "matrix", "parts", "release", "shared_dir", "table", "tables_dir", "text_bytes", "worker_cache"]

#: Maps the bytes of UTF-8 text so that A-Z become a-z; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows that a Python worker takes from an Arrow batch at a time.
SLICE = 1024
#: Spark SQL arguments of translate() for the same mapping.
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def finite_vector(col: str) -> Column:
    """True for arrays with components, none of them null or non-finite."""
    c = F.col(col)
    return F.coalesce(
        (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))),
        F.lit(False),
    )


def main_dimension(df: DataFrame, col: str) -> int:
    """The commonest length of the arrays, the smaller of equals; 0 for an empty table."""
    row = df.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return row[0]["d"] if row else 0


def matrix(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """The values of a binary or list column of equal lengths as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        return data.view(dtype).reshape(-1, width) if len(data) else np.zeros((0, width), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def blobs(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    return sys.modules.setdefault("_pentad_worker", types.ModuleType("_pentad_worker")).__dict__


def release() -> None:
    """Freed memory goes back to the system, which other processes on the machine may need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a worker holds little at a time; empty ones are skipped. At the end, what
    the worker has freed goes back to the system, which other workers on the machine may need."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies f to parts of the Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(f, parts(batches))

    return df.mapInArrow(run, schema)


def text_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and body: the text as UTF-8 bytes, null as empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
    )
