"""Tables with a folder for each of very many sessions, listed and read by the tasks.

Spark's file index keeps every folder and file on the driver, and its scan takes milliseconds to open a file.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickframe.sinks.shared import write_shared
from tickframe.sources import listing, ranges

MANY = 1_000  # folders; with fewer the index does as well
SMALL_BYTES = 4 << 20  # of a file, on average: Spark's cost of opening one, in bytes
TASK_FILES = 2_000
ROWS = 10_000
DEFAULT = "__HIVE_DEFAULT_PARTITION__"
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BinaryType)


def folder_value(folder: str) -> str | None:
    """The value in the name of a folder, as Spark's reader understands it."""
    value = folder.split("=", 1)[1]
    return None if value == DEFAULT else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


def _many_folders(root: str) -> bool:
    system, inner = listing.opened(root)
    if not isinstance(system, fs.LocalFileSystem) or not os.path.isdir(inner):
        return False
    with os.scandir(inner) as entries:
        return sum(1 for _ in itertools.islice(entries, MANY + 1)) > MANY


def _column(batch: pa.RecordBatch, name: str | None, kind: pa.DataType) -> pa.Array:
    if name is None:
        return pa.nulls(batch.num_rows, kind)
    column = batch.column(name)
    return column if column.type == kind else column.cast(kind)


def read_by_tasks(spark: SparkSession, path: str, column: str, schema: T.StructType) -> DataFrame | None:
    """Rows of the files in the folders ``column=``; None where Spark's reader serves better or as well.

    That is a table of few folders or large files, one with other folders or types that Arrow may read differently, and one
    on a file system that is not mounted. Files are those found now, as in Spark's index.
    """
    if any(type(f.dataType) not in _PLAIN and f.dataType != T.StringType() for f in schema) or re.search(r"[*?{}\[\]\\]", path):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    try:
        if not _many_folders(root):
            return None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    found = listing.files_below(spark, path, "*")
    if found is None:
        return None
    found = write_shared(found.select("path", "length"), "listing")
    inside = F.expr(f"substr(path, {len(root) + 2})").rlike(f"^{column}=[^/]*/[^/]+$") & F.startswith("path", F.lit(f"{root}/"))
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.min(inside).alias("plain")).first()
    if not size["plain"] or size["bytes"] > SMALL_BYTES * size["n"]:
        return None
    split = ranges.SPLIT_BYTES
    # A file that is larger than a task should read is read by several, some row groups each.
    parts = F.greatest(F.lit(1), F.ceil(F.col("length") / split)).cast("int")
    pieces = (found.where("length > 0").withColumn("parts", parts)
              .select("path", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size["n"] // TASK_FILES), -(-size["bytes"] // split))
    exact = spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    own = T.StructType([f for f in schema if f.name != column])
    arrow = to_arrow_schema(T.StructType([*own.fields, T.StructField(column, T.StringType())]))
    named = [f.name if exact else f.name.lower() for f in own]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for piece in batch.to_pylist():
                value = folder_value(piece["path"].rsplit("/", 2)[1])
                with ranges.open_file(piece["path"]) as source:
                    file = pq.ParquetFile(source)
                    have = {(n if exact else n.lower()): n for n in file.schema_arrow.names}
                    wanted = [have[n] for n in named if n in have]
                    groups = list(range(piece["part"], file.num_row_groups, piece["parts"]))
                    if not groups:
                        continue
                    if not wanted:
                        some = [pa.RecordBatch.from_arrays([pa.nulls(file.metadata.row_group(g).num_rows)], [""]) for g in groups]
                    else:
                        some = file.iter_batches(ROWS, row_groups=groups, columns=wanted, use_threads=False)
                    for part in some:
                        columns = [_column(part, have.get(n), f.type) for n, f in zip(named, arrow)]
                        held.append(pa.RecordBatch.from_arrays([*columns, pa.repeat(pa.scalar(value, arrow[-1].type), part.num_rows)], schema=arrow))
                        rows += part.num_rows
                        if rows >= ROWS:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return pieces.repartition(tasks, "path", "part").mapInArrow(read, T.StructType([*own.fields, T.StructField(column, T.StringType())]))
