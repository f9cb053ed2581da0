"""Byte ranges of large files, decoded in parallel.

``binaryFile`` puts a whole file into one row, which a session-long log does not survive.
Here a file becomes rows ``(path, offset, size)``, spread over the cluster, and each task reads
its own ranges through the Arrow filesystem layer, which speaks local paths and object
stores alike.
"""

from __future__ import annotations

import math

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT_BYTES = 64 << 20


def open_file(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:"):].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_range(path: str, offset: int, size: int) -> bytes:
    with open_file(path) as source:
        return source.read_at(size, offset)


class RangeReader:
    """Reads ranges that follow one another: a file stays open, and what lies behind a small range is read with it."""

    AHEAD = 256 << 10

    def __init__(self):
        self.path, self.source, self.at, self.held = None, None, 0, b""

    def read(self, path: str, offset: int, size: int) -> bytes:
        if path != self.path:
            self.close()
            self.source, self.path, self.at, self.held = open_file(path), path, 0, b""
        begin = offset - self.at
        if begin < 0 or begin + size > len(self.held):
            self.held, self.at, begin = self.source.read_at(max(size, self.AHEAD), offset), offset, 0
        return self.held if begin == 0 and size >= len(self.held) else self.held[begin:begin + size]

    def close(self) -> None:
        if self.source is not None:
            self.source.close()
        self.path, self.source, self.held = None, None, b""

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def spread(ranges: DataFrame, files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Distributes range rows so that a task gets about ``SPLIT_BYTES``, or one range if those are larger.

    Small ranges of one stretch of a file stay together, in order, so that a task opens the file once. The rows are tiny, so the number of partitions is set from the listed file sizes; left to
    its own estimate Spark would merge them into one task.
    """
    total = files.agg(F.sum("length")).first()[0] or 0
    per_task = max(SPLIT_BYTES, split_bytes or 0)
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, math.ceil(total / per_task))
    stretch = F.call_function("div", F.col("offset"), F.lit(per_task))
    return ranges.repartition(tasks, F.col("path"), stretch).sortWithinPartitions("path", "offset")


def cut(files: DataFrame, record_bytes: int, split_bytes: int | None = None) -> DataFrame:
    """Ranges of whole fixed-size records, ``offset`` and ``size``; a partial tail belongs to none."""
    limit = SPLIT_BYTES if split_bytes is None else split_bytes
    step = max(1, limit // record_bytes)
    records = F.call_function("div", F.col("length"), F.lit(record_bytes))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_records") - 1,
                                 F.lit(step).cast("long")))
    return (files.withColumn("_records", records).where(F.col("_records") > 0)
            .select("*", first.alias("_first"))
            .withColumn("offset", F.col("_first") * record_bytes)
            .withColumn("size", F.least(F.lit(step), F.col("_records") - F.col("_first"))
                        * record_bytes).drop("_records", "_first"))


def fixed_ranges(files: DataFrame, record_bytes: int, split_bytes: int | None = None) -> DataFrame:
    """The ranges of :func:`cut`, dealt out to tasks."""
    return spread(cut(files, record_bytes, split_bytes), files, split_bytes)
