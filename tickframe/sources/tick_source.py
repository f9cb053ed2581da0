"""Tick logs as a data source: ``spark.read.format("tick_log").load(folder)``.

A partition is a run of ranges of whole records, of one or many files, read through the Arrow file system layer. Conditions on
``session_id`` and ``chunk_index`` leave out files, conditions on ``tick`` leave out ranges: a log's ticks ascend, so
the first and the last record of a range tell whether it can hold any. Spark hands conditions down with the option
``pushFilters`` in a session that has ``spark.sql.python.filterPushdown.enabled`` set; the options ``minTick`` and
``maxTick`` do the same for ticks in any session. ``columns`` names the columns wanted, ``glob`` the files,
``splitBytes`` the size of a range.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition,
                                    LessThan, LessThanOrEqual)

from tickframe import schemas as S
from tickframe.sources.binlogs import TICK_DTYPE

# Spark runs sources in processes that know neither the driver's path nor shipped files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIELDS = [("session_id", T.StringType()), ("chunk_index", T.IntegerType()), *[(f.name, f.dataType) for f in S.TICKS]]
_RECORD, _RECORD_BYTES = TICK_DTYPE, S.TICK_RECORD_BYTES
_BATCH_RECORDS = 65_536
_TASK_BYTES = 64 << 20
_TASK_RANGES = 1_024  # small files cost their opening, not their bytes
_FEW = 64  # so many ranges get a task each


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system, inner


def _key(path: str) -> tuple[str, int | None]:
    """Session and chunk of a file, from the names of its folders."""
    folders = path.split("/")[:-1]
    session = next((f.split("=", 1)[1] for f in folders if f.startswith("session_id=")), folders[-1] if folders else "")
    numbers = [f.rsplit("=" if "=" in f else "_", 1)[1] for f in folders if f.startswith(("chunk_index=", "chunk_"))]
    return session, int(numbers[-1]) if numbers and numbers[-1].isdigit() else None


@dataclass
class Ranges(InputPartition):
    """Stretches ``(path below the folder, begin, end)`` of files; a range is a step of one."""
    stretches: list[tuple[str, int, int]]


class TickLogReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.glob = options.get("glob", "gamestate.bin")
        self.step = max(1, int(options.get("splitbytes", 64 << 20)) // _RECORD_BYTES) * _RECORD_BYTES
        self.least, self.most = int(options.get("mintick", -(1 << 31))), int(options.get("maxtick", (1 << 31) - 1))
        self.equal: dict = {}

    def partitions(self) -> list[Ranges]:
        system, inner = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        files = []
        for info in found:
            key = dict(zip(("session_id", "chunk_index"), _key(info.path)))
            if info.is_file and info.base_name == self.glob and all(key[c] == v for c, v in self.equal.items()):
                files.append((info.path[len(inner):], info.size // _RECORD_BYTES * _RECORD_BYTES))
        ranges = sum(-(-whole // self.step) for _, whole in files)
        return list(self._dealt(files, 1 if ranges <= _FEW else min(_TASK_RANGES, -(-ranges // _FEW))))

    def _dealt(self, files: list[tuple[str, int]], most: int) -> Iterator[Ranges]:
        """Runs of at most ``most`` ranges, and of no more bytes than a task should read unless one range has more."""
        own, number, size = [], 0, 0
        for path, whole in files:
            begin = 0
            for at in range(0, whole, self.step):
                step = min(self.step, whole - at)
                if number and (number == most or size + step > _TASK_BYTES):
                    yield Ranges([*own, (path, begin, at)] if at > begin else own)
                    own, number, size, begin = [], 0, 0, at
                number, size = number + 1, size + step
            if whole > begin:
                own.append((path, begin, whole))
        if own:
            yield Ranges(own)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without records
            return
        system, folder = _opened(self.folder)
        held, number = [], 0
        for path, begin, end in partition.stretches:
            session, chunk = _key(folder + path)
            with system.open_input_file(folder + path) as source:
                for at in range(begin, end, self.step):
                    for records in self._wanted(source, at, min(self.step, end - at)):
                        held.append((records, session, chunk))
                        number += len(records)
                        if number >= _BATCH_RECORDS:
                            yield self._batch(held)
                            held, number = [], 0
        if number:
            yield self._batch(held)

    def _wanted(self, source: pa.NativeFile, offset: int, size: int) -> Iterator[np.ndarray]:
        edge = [int(np.frombuffer(source.read_at(4, offset + at), ">i4")[0]) for at in (0, size - _RECORD_BYTES)]
        if edge[1] < self.least or edge[0] > self.most:
            return
        for at in range(0, size, _BATCH_RECORDS * _RECORD_BYTES):
            records = np.frombuffer(source.read_at(min(_BATCH_RECORDS * _RECORD_BYTES, size - at), offset + at), _RECORD)
            yield records[(records["tick"] >= self.least) & (records["tick"] <= self.most)]

    def _batch(self, held: list[tuple[np.ndarray, str, int | None]]) -> pa.RecordBatch:
        records = np.concatenate([r for r, _, _ in held])
        place = pa.array(np.repeat(np.arange(len(held), dtype=np.int32), [len(r) for r, _, _ in held]))
        kinds = {"integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "short": pa.int16(), "byte": pa.int8()}
        columns = []
        for field in self.schema:
            if field.name == "session_id":
                columns.append(pa.array([s for _, s, _ in held], pa.string()).take(place))
            elif field.name == "chunk_index":
                columns.append(pa.array([c for _, _, c in held], pa.int32()).take(place))
            else:
                kind = kinds[field.dataType.typeName()]
                columns.append(pa.array(records[field.name].astype(kind.to_pandas_dtype()), kind))
        return pa.RecordBatch.from_arrays(columns, self.schema.names)


class PushedTickLogReader(TickLogReader):
    """The reader that Spark hands conditions to. Spark refuses such a reader where that is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what can be decided from ticks, sessions and chunks; the rest stays with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
            if column == ("tick",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most = min(self.most, value - isinstance(f, LessThan))
            elif column in (("session_id",), ("chunk_index",)) and isinstance(f, EqualTo) and self.equal.get(column[0], value) == value:
                self.equal[column[0]] = value
            else:
                yield f


class TickLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tick_log"

    def schema(self) -> T.StructType:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return T.StructType([T.StructField(n, t) for n, t in _FIELDS if not wanted or n in wanted])

    def reader(self, schema: T.StructType) -> TickLogReader:
        kind = PushedTickLogReader if self.options.get("pushfilters", "").lower() == "true" else TickLogReader
        return kind(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes ``tick_log`` known to a session."""
    spark.dataSource.register(TickLogSource)
