"""File listings as DataFrames; file contents are not read.

Folders are listed by tasks, so a listing of millions of files passes neither through the driver nor through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickframe.runtime import ship_package

_LISTING = "path string, modificationTime timestamp, length long, content binary"


def session_of(path: Column) -> Column:
    """Session of a file: its ``session_id=`` folder, else the folder above ``chunks`` or the file."""
    keyed = F.regexp_extract(path, r"session_id=([^/]+)", 1)
    folder = F.regexp_extract(path, r"([^/]+)/(?:chunks/(?:chunk_\d+/)?)?[^/]+$", 1)
    return F.when(keyed != "", keyed).otherwise(folder)


def chunk_of(path: Column) -> Column:
    """Chunk number in the path, null when the file is not inside a chunk folder."""
    digits = F.regexp_extract(path, r"/chunk(?:_index=|_)(\d+)/", 1)
    return F.when(digits != "", digits.cast("int"))


def missing(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below ``path`` matching ``glob``; no row when there are none.

    ``content`` is loaded only by queries that use it.
    """
    reader = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
              .option("recursiveFileLookup", "true"))
    try:
        files = reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = missing(spark, _LISTING)
    return files.select(session_of(F.col("path")).alias("session_id"),
                        chunk_of(F.col("path")).alias("chunk_index"),
                        "path", "length", "modificationTime", "content")


_FOUND = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("folder", T.BooleanType()),
    T.StructField("length", T.LongType()), T.StructField("modificationTime", T.TimestampType())])
_BATCH_FILES = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; raises where there is none outside the JVM."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _children(folder: str, deep: bool) -> Iterator[tuple]:
    """What lies in a folder, or with ``deep`` the files below it."""
    system, inner = opened(folder)
    prefix = folder[:len(folder) - len(inner)] if folder.endswith(inner) else folder.split(":", 1)[0] + ":"
    for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if _hidden(info.base_name):
            continue
        path, is_folder = prefix + info.path, info.type == fs.FileType.Directory
        if is_folder and deep:
            yield from _children(path, deep)
        else:
            time = info.mtime_ns // 1_000_000 * 1000 if info.mtime_ns is not None else None
            yield path, info.base_name, is_folder, 0 if is_folder else info.size, time


def _listed(found: DataFrame, deep: bool) -> DataFrame:
    """Folders among ``found`` replaced by what is in them."""
    schema = to_arrow_schema(_FOUND)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()).cast(pa.timestamp("us")).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type)
             for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            folders = own.column("folder").to_pylist()
            yield own.filter(pa.array([not f for f in folders], pa.bool_()))
            rows = []
            for path in own.filter(own.column("folder")).column("path").to_pylist():
                for row in _children(path, deep):
                    rows.append(row)
                    if len(rows) == _BATCH_FILES:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return found.mapInArrow(run, _FOUND)


def _roots(spark: SparkSession, path: str):
    """What ``path``, which may be a pattern, names: full path, name and kind of each."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime())
            for s in system.globStatus(name) or []]


def files_below(spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    """Files below ``path`` matching ``glob``, empty ones too; None where there is no such path or no file system for it in tasks."""
    roots = _roots(spark, path)
    if not roots:
        return None
    try:
        for root in roots:
            opened(root[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    ship_package(spark)
    found = spark.createDataFrame(roots, "path string, name string, folder boolean, length long, ms long").select(
        "path", "name", "folder", "length", F.timestamp_millis("ms").alias("modificationTime"))
    tasks = spark.sparkContext.defaultParallelism
    # Two levels are dealt out, whatever hangs below them; the rows of a listing are small.
    for deep in (False, False, True):
        found = _listed(found.repartition(tasks, "path"), deep)
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()
    return found.where(F.col("name").rlike(f"^(?s:{pattern})$")).drop("name", "folder")


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below ``path`` matching ``glob`` that are not empty; no row when there are none."""
    found = list_files_by_tasks(spark, path, glob)
    return read_files(spark, path, glob).drop("content") if found is None else found


def list_files_by_tasks(spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    """:func:`list_files`, or None where ``path`` does not exist or tasks have no file system for it."""
    found = files_below(spark, path, glob)
    if found is None:
        return None
    return found.where("length > 0").select(session_of(F.col("path")).alias("session_id"), chunk_of(F.col("path")).alias("chunk_index"),
                                            "path", "length", "modificationTime")


def landed_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """A stream of the files that land below ``path``; contents are not read."""
    files = (spark.readStream.format("binaryFile").schema(_LISTING).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return files.select(session_of(F.col("path")).alias("session_id"), chunk_of(F.col("path")).alias("chunk_index"), "path", "length")


def list_folders(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``folder`` of every file called ``name`` below ``path``, empty files among them.

    Spark's scan leaves out empty files, its index does not; where tasks cannot list, the index serves, on the driver.
    """
    listed = files_below(spark, path, name)
    if listed is not None:
        return listed.select(F.regexp_replace("path", "/[^/]+$", "").alias("folder")).distinct()
    reader = (spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true"))
    try:
        found = reader.load(path).inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    folders = spark.createDataFrame([(f.rsplit("/", 1)[0],) for f in found], "folder string")
    # Spark writes local paths with one slash in a scan and with three in the index.
    return folders.select(F.regexp_replace("folder", "^file:/+", "file:/").alias("folder")).distinct()


def discover_sessions(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Sessions with files below ``path``, their newest change and file count."""
    return (list_files(spark, path, glob).groupBy("session_id")
            .agg(F.max("modificationTime").alias("modified_at"), F.count("*").alias("files")))
