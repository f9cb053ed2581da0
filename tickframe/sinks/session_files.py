"""Parquet files of many sessions, written by the tasks through Arrow.

Spark's writer opens, closes and places a file per session at a cost of tens of milliseconds on a local or mounted folder,
where it starts a process to set the mode of each file. A table of short sessions is little else than such files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.operators.row_runs import run_starts
from tickframe.runtime import ship_package
from tickframe.sources.listing import opened

GROUP_BYTES = 32 << 20  # of a row group
DEFAULT = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 0x20), 0x7F, *map(ord, "\"#%'*/:=?\\{[]^")]}
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BinaryType,
          T.DateType, T.TimestampType, T.TimestampNTZType)


def folder_name(column: str, value: str | None) -> str:
    """The folder Spark's writer would choose for a value."""
    return f"{column}={value.translate(_ESCAPED) if value else DEFAULT}"


def _same_in_arrow(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_same_in_arrow(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _same_in_arrow(kind.elementType)
    if isinstance(kind, T.MapType):
        return _same_in_arrow(kind.keyType) and _same_in_arrow(kind.valueType)
    return type(kind) in _PLAIN or kind == T.StringType()


class _Folders:
    """The files of a task: rows come in runs of one folder, and a file is open at a time."""

    def __init__(self, root: str, name: str, most: int):
        self.system, self.root = opened(root)
        self.name, self.most = name, most
        self.local = isinstance(self.system, fs.LocalFileSystem)
        self.folder, self.held, self.bytes, self.rows = None, [], 0, 0
        self.writer = self.sink = self.at = None
        self.files = 0

    def add(self, folder: str, batch: pa.RecordBatch) -> None:
        if folder != self.folder:
            self.close()
            self.folder = folder
        while batch.num_rows:
            part = batch.slice(0, self.most - self.rows)
            self.held.append(part)
            self.bytes += part.nbytes
            self.rows += part.num_rows
            if self.bytes >= GROUP_BYTES:
                self._flush()
            if self.rows == self.most:
                self.close()
            batch = batch.slice(part.num_rows)

    def _flush(self) -> None:
        if not self.held:
            return
        table = pa.Table.from_batches(self.held)
        if self.writer is None:
            folder = f"{self.root}/{self.folder}"
            self.system.create_dir(folder, recursive=True)
            name = f"{self.name}.c{self.files:03d}.snappy.parquet"
            self.at = f"{folder}/{name}", f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}" if self.local else f"{folder}/{name}"
            self.sink = self.system.open_output_stream(self.at[1])
            self.writer = pq.ParquetWriter(self.sink, table.schema, compression="snappy", store_schema=False)
            self.files += 1
        self.writer.write_table(table, row_group_size=max(1, table.num_rows))
        self.held, self.bytes = [], 0

    def close(self) -> None:
        self._flush()
        if self.writer is not None:
            self.writer.close()
            self.sink.close()
            if self.local:  # a whole file appears at once, whoever else writes the same one
                self.system.move(self.at[1], self.at[0])
        self.writer, self.rows = None, 0


def write_by_tasks(sorted_rows: DataFrame, column: str, path: str, mode: str, most: int, options: dict[str, str]) -> bool:
    """Writes rows, sorted by ``column`` within partitions, to folders by it, as Spark's writer would.

    False, with nothing done, where the tasks have no file system for ``path``, a type is not the same in Arrow, or the
    session replaces single folders.
    """
    spark = sorted_rows.sparkSession
    others = [f for f in sorted_rows.schema.fields if f.name != column]
    if len(others) != len(sorted_rows.columns) - 1 or not others or not _same_in_arrow(T.StructType(others)):
        return False
    if spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static").lower() != "static":
        return False
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(target).toString()
    try:
        opened(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    if mode == "ignore" and system.exists(target):
        return True
    # Spark's writer judges the mode and clears the folder; it says in the end, not now, that the table is whole.
    (sorted_rows.limit(0).write.mode(mode).options(**options).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
     .partitionBy(column).parquet(path))
    system.mkdirs(target)
    ship_package(spark)
    job = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = _Folders(root, f"part-{TaskContext.get().partitionId():05d}-{job}", most)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.drop_columns([_NAME])
            starts = run_starts(batch, [_NAME]).tolist()
            names = batch.column(_NAME)
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                folders.add(folder_name(column, names[a].as_py()), data.slice(a, b - a))
        folders.close()
        yield pa.RecordBatch.from_arrays([pa.array([folders.files], pa.int64())], ["files"])

    named = sorted_rows.select(*[F.col(f"`{f.name}`") for f in others], F.col(column).cast("string").alias(_NAME))
    named.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    system.create(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS"), True).close()
    return True


_NAME = "_folder_of"
