"""Builds log bytes from rows, one log per (session, chunk), to exercise the readers.

A chunk has a bounded number of rows. Partitions are sorted by chunk and packed batch by
batch, so no chunk is gathered as a group.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from tickframe import schemas as S
from tickframe.operators.row_runs import key_at, run_starts
from tickframe.runtime import ship_package
from tickframe.sources.binlogs import CAPTURE_DTYPE, OLD_CAPTURE_DTYPE, TICK_DTYPE

_KEYS = ("session_id", "chunk_index")
_LOG = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
                     T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def _by_chunk(rows: DataFrame, order: str, pack: Callable[[pa.RecordBatch], list[bytes]],
              finish: Callable[[int, bytes, int], bytes] = lambda first, body, count: body) -> DataFrame:
    """``pack`` gives the bytes of each row; ``finish`` adds what surrounds a chunk's rows."""
    ship_package(rows.sparkSession)
    schema = to_arrow_schema(_LOG)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def log(key, first, parts):
            session, chunk = key
            content = finish(first, b"".join(parts), len(parts))
            return session, chunk, f"session_id={session}/chunk_index={chunk}/log", content

        key, first, parts = None, 0, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            packed, logs = pack(batch), []
            starts = run_starts(batch, _KEYS)
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                found = key_at(batch, _KEYS, int(start))
                if found != key:
                    if key is not None:
                        logs.append(log(key, first, parts))
                    key, first, parts = found, batch.column(order)[int(start)].as_py(), []
                parts.extend(packed[start:end])
            if logs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*logs), schema)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(log(key, first, parts), schema)], schema=schema)

    return (rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, order)
            .mapInArrow(build, _LOG))


def _records(dtype: np.dtype) -> Callable[[pa.RecordBatch], list[bytes]]:
    def pack(batch: pa.RecordBatch) -> list[bytes]:
        out = np.zeros(batch.num_rows, dtype)
        for name in dtype.names:
            if name in batch.schema.names:
                out[name] = batch.column(name).to_numpy(zero_copy_only=False)
        data, size = out.tobytes(), dtype.itemsize
        return [data[i:i + size] for i in range(0, len(data), size)]

    return pack


def _tuples(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names])


def encode_ticks(rows: DataFrame, order: str = "tick") -> DataFrame:
    return _by_chunk(rows, order, _records(TICK_DTYPE))


def pack_event(tick: int, code: int, name: str, count: int, prev_count: int) -> bytes:
    raw = name.encode("utf-8")[:S.NAME_LIMIT_BYTES]
    return struct.pack(">iBB", tick, code, len(raw)) + raw + struct.pack(">hh", count, prev_count)


def encode_events(rows: DataFrame, order: str) -> DataFrame:
    return _by_chunk(rows, order, lambda batch: [
        pack_event(*row) for row in _tuples(batch, S.EVENTS.names)])


def pack_packet(version: int, tick: int, stamp: int, kind: int, data: bytes) -> bytes:
    if version == 2:
        return struct.pack("<IIHI", tick, stamp, kind, len(data)) + data
    return struct.pack("<IHH", tick, kind, len(data)) + data


def encode_packets(rows: DataFrame, order: str, version: int) -> DataFrame:
    fields = ("tick", "timestamp_ms", "packet_id", "data")
    return _by_chunk(rows, order, lambda batch: [
        pack_packet(version, *row) for row in _tuples(batch, fields)])


def pack_capture(start_tick: int, records: bytes, count: int) -> bytes:
    """A capture chunk: header, length prefix, LZ4 block; the CRC covers prefix and block."""
    block = pa.Codec("lz4_raw").compress(records, asbytes=True)
    payload = struct.pack("<I", len(records)) + block
    return struct.pack("<4sHIHBIII", S.CAPTURE_MAGIC, 1, start_tick, count, S.CAPTURE_CODEC_LZ4,
                       len(records), len(payload), zlib.crc32(payload)) + payload


def encode_capture(rows: DataFrame, order: str, old: bool = False) -> DataFrame:
    return _by_chunk(rows, order, _records(OLD_CAPTURE_DTYPE if old else CAPTURE_DTYPE), pack_capture)


def write_files(logs: DataFrame, root: str, name: str) -> None:
    """One file ``name`` per log below ``root``, in the folders of its session and chunk, written by the tasks."""
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{root}/session_id={row['session_id']}/chunk_{row['chunk_index']}"
                system, inner = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
                system.create_dir(inner)
                # Under another name first: a task that runs twice leaves one whole file.
                with system.open_output_stream(f"{inner}/.{name}.new") as out:
                    out.write(row["content"])
                system.move(f"{inner}/.{name}.new", f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    ship_package(logs.sparkSession)
    logs.mapInArrow(write, "files long").agg({"files": "sum"}).collect()
