"""Shared pieces of the operators: columns they read, tables they write, Arrow batches in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.runtime import ship_package
from tickframe.sinks.shared import write_shared

TASK_ROWS = 4096  # documents, or what follows their number, whose small tables share a task


def by_bucket(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """Rows of each ``key`` of a partition that is sorted by it."""
    bucket, rows = None, []
    for batch in batches:
        # A few rows at a time: a batch may hold several buckets, and only one is copied.
        for a in range(0, batch.num_rows, 64):
            for row in batch.slice(a, 64).to_pylist():
                if row[key] != bucket and rows:
                    yield bucket, rows
                    rows = []
                bucket = row[key]
                rows.append(row)
    if rows:
        yield bucket, rows


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string (null: empty), with the further columns named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def training_row(modulus: int, held_out: int) -> Column:
    """False for rows held out: crc32 of the id as text leaves ``held_out``. A null id trains."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out, F.lit(True))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def batches_of(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about ``size`` bytes of ``column``, but a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        if values.nbytes <= size:
            yield batch
            continue
        lengths = values.to_numpy(zero_copy_only=False) if pa.types.is_integer(values.type) else None
        if lengths is None:
            import pyarrow.compute as pc

            lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // size
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column: run ``i`` of ``sizes[i]`` values as their little-endian bytes."""
    width = values.dtype.itemsize
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def binary(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column in a row, and the number of values in each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(bounds) // width


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tasks_for(rows: int, each: int = TASK_ROWS) -> int:
    """Tasks that take ``each`` of the rows, one at least."""
    return max(1, -(-rows // each))


def dealt(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` in at most ``tasks`` partitions, merged without a shuffle: a tiny one costs a task, a Python call and a file like any other."""
    return df if tasks is None else df.coalesce(tasks)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    return write_shared(df, f"llm-{name}")
