"""Binary session logs as DataFrames.

Fixed-size records are cut anywhere on a record border. Variable-size records carry no
sync marker; ``borders.py`` finds where they begin in a file larger than one split. All records of a
piece are decoded together, as columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickframe import schemas as S
from tickframe.functions.labels import record_size
from tickframe.runtime import ship_package
from tickframe.sources import borders, ranges
from tickframe.sources.listing import landed_files, list_files, list_folders, read_files

_WHERE = T.StructType([T.StructField("session_id", T.StringType()),
                       T.StructField("chunk_index", T.IntegerType())])

TICK_DTYPE = np.dtype([(f.name, {"integer": ">i4", "long": ">i8", "float": ">f4",
                                  "short": ">i2", "byte": "i1"}[f.dataType.typeName()])
                        for f in S.TICKS])
assert TICK_DTYPE.itemsize == S.TICK_RECORD_BYTES

CAPTURE_DTYPE = np.dtype([
    ("flags", "<u2"), ("hotbar", "u1"), ("mouse_btn", "u1"), ("yaw_fp", "<i2"), ("pitch_fp", "<i2"),
    ("recorded_tick", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("health", "<f4"),
    ("food", "u1"), ("screen_type", "u1"), ("xp_level", "<u2"),
    ("vel_x", "<f4"), ("vel_y", "<f4"), ("vel_z", "<f4"), ("cursor_x", "<i2"), ("cursor_y", "<i2")])
assert CAPTURE_DTYPE.itemsize == S.CAPTURE_RECORD_BYTES

# Older record: only the leading fields, unaligned.
OLD_CAPTURE_DTYPE = np.dtype({
    "names": ["flags", "hotbar", "yaw_fp", "pitch_fp", "recorded_tick"],
    "formats": ["<u2", "u1", "<i2", "<i2", "<u4"], "offsets": [0, 2, 3, 5, 7],
    "itemsize": S.OLD_CAPTURE_RECORD_BYTES})


def _in_python(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    return df


def _with(schema: T.StructType) -> T.StructType:
    return T.StructType([*_WHERE.fields, *schema.fields])


# Bytes decoded before a batch of rows is handed back to Spark.
_BATCH_BYTES = 8 << 20


def _batches(blocks: Iterator[tuple[dict, bytes]]) -> Iterator[list[tuple[dict, bytes]]]:
    """Groups blocks, so that many small logs become few batches."""
    group, size = [], 0
    for row, data in blocks:
        group.append((row, data))
        size += len(data)
        if size >= _BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _blocks(batches: Iterator[pa.RecordBatch], content: str | None) -> Iterator[tuple[dict, bytes]]:
    """Descriptor and bytes of each block, read by path and range unless a column holds them.

    A column's bytes are handed on where they lie; a batch of logs is not copied into Python objects.
    """
    with ranges.RangeReader() as reader:
        for batch in batches:
            held = _contents(batch.column(content)) if content else None
            for k, row in enumerate(_descriptors(batch, content)):
                yield row, held[k] if content else reader.read(row["path"], row["offset"], row["size"])


def _descriptors(batch: pa.RecordBatch, content: str | None) -> list[dict]:
    return batch.select([n for n in batch.schema.names if n != content]).to_pylist()


def _contents(held: pa.Array) -> list[memoryview]:
    """The values of a binary column, as views of its bytes."""
    _, bounds, data = held.buffers()
    kind = np.int64 if pa.types.is_large_binary(held.type) else np.int32
    at = np.frombuffer(bounds, kind)[held.offset:held.offset + len(held) + 1].tolist() if len(held) else [0]
    whole = memoryview(b"" if data is None else data).cast("B")  # Arrow's bytes are signed
    return [whole[a:b] for a, b in zip(at, at[1:])]


def _batch(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns the source lacks are null."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type)
         for f in schema], schema=schema)


def _repeated(values: list, counts: list[int]) -> pa.Array:
    """Each value as often as its count says."""
    codes = np.repeat(np.arange(len(values), dtype=np.int32), counts)
    return pa.array(values).take(pa.array(codes))


def _native(records: np.ndarray, schema: pa.Schema) -> dict[str, np.ndarray]:
    """Record fields in native byte order and the declared (wider) type."""
    return {f.name: records[f.name].astype(f.type.to_pandas_dtype())
            for f in schema if f.name in records.dtype.names}


def _origin(group: list[tuple[dict, bytes]], counts: list[int]) -> dict:
    return {"session_id": _repeated([row["session_id"] for row, _ in group], counts).cast(pa.string()),
            "chunk_index": _repeated([row["chunk_index"] for row, _ in group], counts).cast(pa.int32())}


# --- tick log ---------------------------------------------------------------

def decode_tick_ranges(blocks: DataFrame, content: str | None = None) -> DataFrame:
    """Tick rows from ``(path, offset, size)`` rows, or from a binary column."""
    out = _with(S.TICKS)
    schema = to_arrow_schema(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _batches(_blocks(batches, content)):
            counts = [len(data) // S.TICK_RECORD_BYTES for _, data in group]
            whole = b"".join(data[:n * S.TICK_RECORD_BYTES] for (_, data), n in zip(group, counts))
            columns = _native(np.frombuffer(whole, TICK_DTYPE), schema)
            yield _batch(schema, {**columns, **_origin(group, counts)}, sum(counts))

    return _in_python(blocks).mapInArrow(decode, out)


def read_ticks(spark: SparkSession, path: str, glob: str = "gamestate.bin",
               split_bytes: int | None = None) -> DataFrame:
    """68-byte big-endian tick records; a partial record at the end is left out."""
    files = list_files(spark, path, glob)
    return decode_tick_ranges(ranges.fixed_ranges(files, S.TICK_RECORD_BYTES, split_bytes))


def stream_ticks(spark: SparkSession, path: str, glob: str = "gamestate.bin", split_bytes: int | None = None) -> DataFrame:
    """Tick rows of logs as they land (R1): a file is read once, when it has come, and must not grow after.

    Spark's file source keeps the offsets of what it has passed on; only names and sizes go through it.
    """
    files = landed_files(spark, path, glob)
    return decode_tick_ranges(ranges.cut(files, S.TICK_RECORD_BYTES, split_bytes).repartition("path", "offset"))


def tick_rejects(spark: SparkSession, path: str, glob: str = "gamestate.bin") -> DataFrame:
    """Files whose length is not a whole number of records."""
    trailing = F.col("length") % S.TICK_RECORD_BYTES
    return (list_files(spark, path, glob)
            .select("session_id", "path", "length", trailing.alias("trailing_bytes"))
            .where(F.col("trailing_bytes") != 0))


# --- variable-size records --------------------------------------------------

_PIECES = T.StructType([*_WHERE.fields,
                        T.StructField("path", T.StringType()), T.StructField("format", T.StringType()),
                        T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()),
                        T.StructField("first_pos", T.LongType())])


def _pieces(files: DataFrame, split_bytes: int | None) -> DataFrame:
    """Pieces of every file; ``files`` has a ``format`` column. Small files stay whole."""
    limit = ranges.SPLIT_BYTES if split_bytes is None else split_bytes
    listed = files.select(*_WHERE.names, "path", "format", "length")
    small = listed.where(F.col("length") <= limit).select(
        *_WHERE.names, "path", "format", F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("size"), F.lit(0).cast("long").alias("first_pos"))
    large = borders.pieces(listed.where(F.col("length") > limit), limit).select(*_PIECES.names)
    return ranges.spread(small.unionByName(large), files, limit)


def log_coverage(files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Records and bytes of every file that whole records cover, and the bytes after them.

    ``session_id, path, length, records, bytes_read, trailing_bytes``; covered and trailing bytes make up the length.
    """
    limit = ranges.SPLIT_BYTES if split_bytes is None else split_bytes
    covered = borders.pieces(files, limit).groupBy("path").agg(
        F.sum("records").alias("records"), F.sum("size").alias("bytes_read"))
    none = F.lit(0).cast("long")
    return (files.select("session_id", "path", "length").join(covered, "path", "left")
            .select("session_id", "path", "length", F.coalesce("records", none).alias("records"),
                    F.coalesce("bytes_read", none).alias("bytes_read"),
                    (F.col("length") - F.coalesce("bytes_read", none)).alias("trailing_bytes")))


def _variable_rejects(files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Bytes at the end of a file that no whole record covers."""
    return (log_coverage(files, split_bytes).select("session_id", "path", "length", "trailing_bytes")
            .where(F.col("trailing_bytes") != 0))


def _numbers(raw: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Numbers of one type at the given places."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[at[:, None] + np.arange(width)]).view(kind).ravel()


def _gathered(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many spans in a row, and their bounds."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return raw[np.arange(total) + np.repeat(starts - upto + sizes, sizes)], np.concatenate([[0], upto])


def _names(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts of the spans; bytes that are no UTF-8 become the replacement character."""
    flat, bounds = _gathered(raw, starts, sizes)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in found.to_pylist()], pa.string())


def decode_events(blocks: DataFrame, content: str | None = None) -> DataFrame:
    """Event rows from pieces of event logs, or from a binary column.

    Decoding stops at the first record the block does not hold completely.
    """
    out = _with(S.EVENTS)
    schema = to_arrow_schema(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _batches(_blocks(batches, content)):
            raw, starts, counts = _joined(group, lambda row: "event")
            sizes = raw[starts + 5].astype(np.int64)
            tail = starts + S.EVENT_HEADER_BYTES + sizes
            columns = {"tick": _numbers(raw, starts, ">i4").astype(np.int32), "event_type": raw[starts + 4].astype(np.int16),
                       "item_name": _names(raw, starts + S.EVENT_HEADER_BYTES, sizes),
                       "count": _numbers(raw, tail, ">i2").astype(np.int16),
                       "prev_count": _numbers(raw, tail + 2, ">i2").astype(np.int16)}
            yield _batch(schema, {**columns, **_origin(group, counts)}, len(starts))

    return _in_python(blocks).mapInArrow(decode, out)


def _joined(group: list[tuple[dict, bytes]], kind) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The blocks' bytes in a row, the places of all their records in them, and the records per block."""
    raw = np.frombuffer(b"".join(data for _, data in group) or b"\0", np.uint8)
    found, at = [], 0
    for row, data in group:
        found.append(borders.record_starts(data, kind(row))[0] + at)
        at += len(data)
    return raw, np.concatenate(found) if found else np.zeros(0, np.int64), [len(f) for f in found]


def event_files(spark: SparkSession, path: str, glob: str = "gamestate_events.bin") -> DataFrame:
    return list_files(spark, path, glob).withColumn("format", F.lit("event"))


def read_events(spark: SparkSession, path: str, glob: str = "gamestate_events.bin",
                split_bytes: int | None = None) -> DataFrame:
    """Variable-size big-endian event records."""
    return decode_events(_pieces(event_files(spark, path, glob), split_bytes))


def event_rejects(spark: SparkSession, path: str, glob: str = "gamestate_events.bin",
                  split_bytes: int | None = None) -> DataFrame:
    return _variable_rejects(event_files(spark, path, glob), split_bytes)


def decode_packets(blocks: DataFrame, content: str | None = None, payload: bool = True) -> DataFrame:
    """Packet rows from pieces of packet logs; ``pos`` is the place in the file.

    Without ``payload`` the ``data`` column is null and payload bytes stay in Python.
    """
    out = _with(S.PACKETS)
    schema = to_arrow_schema(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in _batches(_blocks(batches, content)):
            for kind in ("packet_v1", "packet_v2"):
                group = [(row, data) for row, data in mixed if row["format"] == kind]
                if not group:
                    continue
                raw, starts, counts = _joined(group, lambda row: kind)
                n, v2 = len(starts), kind == "packet_v2"
                header = borders.FORMATS[kind][0]
                sizes = _numbers(raw, starts + (10 if v2 else 6), "<u4" if v2 else "<u2").astype(np.int64)
                first = np.repeat([row["first_pos"] for row, _ in group], counts)
                upto = np.cumsum(counts)
                columns = {"pos": first + np.arange(n) - np.repeat(upto - counts, counts),
                           "tick": _numbers(raw, starts, "<u4").astype(np.int64),
                           "packet_id": _numbers(raw, starts + (8 if v2 else 4), "<u2").astype(np.int32), "data_len": sizes}
                if v2:
                    columns["timestamp_ms"] = _numbers(raw, starts + 4, "<u4").astype(np.int64)
                if payload:
                    whole = memoryview(raw)
                    columns["data"] = [bytes(whole[a:b]) for a, b in zip((starts + header).tolist(), (starts + header + sizes).tolist())]
                yield _batch(schema, {**columns, **_origin(group, counts)}, n)

    return _in_python(blocks).mapInArrow(decode, out)


def packet_files(spark: SparkSession, path: str) -> DataFrame:
    """Packet logs with their version: 2 when the marker lies in the same folder."""
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    markers = list_folders(spark, path, "packets_v2.marker").withColumn("_v2", F.lit("packet_v2"))
    return (list_files(spark, path, "packets.bin").withColumn("folder", folder)
            .join(markers, "folder", "left")
            .withColumn("format", F.coalesce("_v2", F.lit("packet_v1"))).drop("_v2", "folder"))


def read_packets(spark: SparkSession, path: str, payload: bool = True,
                 split_bytes: int | None = None) -> DataFrame:
    """Packet logs of version 1 and 2 (S4); stops at a truncated payload."""
    return decode_packets(_pieces(packet_files(spark, path), split_bytes), payload=payload)


def packet_rejects(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    return _variable_rejects(packet_files(spark, path), split_bytes)


# --- capture chunks ---------------------------------------------------------

def little_endian(content: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer inside a binary column."""
    digits = F.hex(F.substring(content, offset + 1, size))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("long")


def chunk_headers(chunks: DataFrame) -> DataFrame:
    """Header fields, payload CRC and status of capture chunks.

    ``chunks`` has ``session_id``, ``path`` and ``content``. The status names the first check
    that fails; the CRC covers the payload with its length prefix.
    """
    content = F.col("content")
    magic = F.substring(content, 1, 4)
    header = S.CAPTURE_HEADER_BYTES
    whole = F.octet_length(content) >= header
    field = lambda offset, size: F.when(whole, little_endian(content, offset, size))
    checked = chunks.select(
        "session_id", "path", F.octet_length(content).cast("long").alias("byte_len"),
        F.when(whole, magic == F.lit(S.CAPTURE_MAGIC)).alias("_magic"),
        field(4, 2).cast("int").alias("schema_version"), field(6, 4).alias("start_tick"),
        field(10, 2).alias("tick_count"), field(12, 1).cast("int").alias("codec"),
        field(13, 4).alias("uncompressed_len"), field(17, 4).alias("compressed_len"),
        field(21, 4).alias("crc"),
        F.when(whole, F.crc32(F.substring(content, header + 1, 2**31 - 1 - header))).alias("payload_crc"),
    )
    status = (F.when(F.col("_magic").isNull(), "short")
              .when(~F.col("_magic"), "magic")
              .when(F.col("codec") != S.CAPTURE_CODEC_LZ4, "codec")
              .when(F.col("crc") != F.col("payload_crc"), "crc")
              .otherwise("ok"))
    return checked.withColumn("status", status).drop("_magic")


def read_chunk_headers(spark: SparkSession, path: str, glob: str = "*.cap") -> DataFrame:
    return chunk_headers(read_files(spark, path, glob))


_TAGGED = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("file_bytes", T.LongType()), T.StructField("declared", T.IntegerType()), T.StructField("records", T.IntegerType()),
    T.StructField("spare_bytes", T.LongType()), T.StructField("place", T.StructType([
        T.StructField("chunk_start", T.LongType()), T.StructField("path", T.StringType()), T.StructField("row", T.IntegerType())])),
    *S.CAPTURE_TICKS.fields])


def _unpacked_chunk(data: bytes, lz4: pa.Codec, detect_size: bool) -> dict:
    """What becomes of one chunk file: an outcome, and the records if it holds any.

    ``short`` has no room for a header and a length and ``block`` does not decompress; both give no records. ``codec``
    names another codec, but gives its records if they can be unpacked all the same, as an export does.
    ``over-counted`` has fewer whole records than its header declares and gives those.
    """
    prefix = S.CAPTURE_HEADER_BYTES + 4
    if len(data) < prefix:
        return {"outcome": "short"}
    start, declared, codec = struct.unpack_from("<IHB", data, 6)
    foreign = codec != S.CAPTURE_CODEC_LZ4
    size, = struct.unpack_from("<I", data, S.CAPTURE_HEADER_BYTES)
    try:
        raw = lz4.decompress(data[prefix:], size, asbytes=True)
    except (OSError, ValueError):
        return {"outcome": "codec" if foreign else "block", "declared": declared}
    width = S.CAPTURE_RECORD_BYTES
    if detect_size and len(raw) % width and len(raw) % S.OLD_CAPTURE_RECORD_BYTES == 0:
        width = S.OLD_CAPTURE_RECORD_BYTES
    records = min(declared, len(raw) // width)
    outcome = "codec" if foreign else "ok" if records == declared else "over-counted"
    return {"outcome": outcome, "declared": declared, "records": records, "start": start,
            "width": width, "raw": raw[:records * width], "spare_bytes": len(raw) - records * width}


def decode_capture_tagged(chunks: DataFrame, content: str | None = None, detect_size: bool = False) -> DataFrame:
    """Tick records of capture chunks and one row per file, from one pass over the files.

    A row with an ``outcome`` stands for a file: its bytes, the records declared and those given, and the unpacked bytes
    behind them. All others are ticks, numbered by position; ``place`` orders the rows of a session by their chunk's
    start, its path and the row in it. Write the table before both kinds are used, or the files are read twice.
    """
    schema = to_arrow_schema(_TAGGED)
    ticks = to_arrow_schema(S.CAPTURE_TICKS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
        lz4 = pa.Codec("lz4_raw")
        for batch in batches:
            held = _contents(batch.column(content)) if content else None
            for k, row in enumerate(_descriptors(batch, content)):
                data = held[k] if content else ranges.read_range(row["path"], 0, row["length"])
                told = _unpacked_chunk(data, lz4, detect_size)
                yield {"session_id": row["session_id"], "path": row["path"], "file_bytes": len(data), **told}, told.pop("raw", b"")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in _batches(found(batches)):
            files = {n: [row.get(n) for row, _ in mixed] for n in
                     ("session_id", "path", "outcome", "file_bytes", "declared", "records", "spare_bytes")}
            files["records"] = [n or 0 for n in files["records"]]
            yield _batch(schema, files, len(mixed))
            for width, dtype in ((S.CAPTURE_RECORD_BYTES, CAPTURE_DTYPE),
                                 (S.OLD_CAPTURE_RECORD_BYTES, OLD_CAPTURE_DTYPE)):
                group = [(row, raw) for row, raw in mixed if raw and row["width"] == width]
                if not group:
                    continue
                counts = [row["records"] for row, _ in group]
                n = sum(counts)
                columns = _native(np.frombuffer(b"".join(raw for _, raw in group), dtype), ticks)
                starts = np.repeat(np.array([row["start"] for row, _ in group], np.int64), counts)
                within = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
                columns["tick"] = starts + within
                columns["record_size"] = np.full(n, width, np.int32)
                for name in ("session_id", "path"):
                    columns[name] = _repeated([row[name] for row, _ in group], counts).cast(pa.string())
                columns["place"] = pa.StructArray.from_arrays(
                    [pa.array(starts), columns["path"], pa.array(within, pa.int32())], ["chunk_start", "path", "row"])
                yield _batch(schema, columns, n)

    return _in_python(chunks.select("session_id", "path", content or "length")).mapInArrow(decode, _TAGGED)


def captured_ticks(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("outcome").isNull()).select("session_id", "path", "place", *S.CAPTURE_TICKS.names)


def captured_files(tagged: DataFrame) -> DataFrame:
    """One row per chunk file: what became of it, and its bytes and records."""
    return tagged.where(F.col("outcome").isNotNull()).select(
        "session_id", "path", "outcome", "file_bytes", "declared", "records", "spare_bytes")


def decode_capture(chunks: DataFrame, content: str | None = None, detect_size: bool = False) -> DataFrame:
    """The tick records of :func:`decode_capture_tagged` alone.

    Tasks read the chunk files by ``path``, or take the bytes from a binary column. With ``detect_size`` the
    record size is guessed from the payload length, so 28-byte records are read too.
    """
    return captured_ticks(decode_capture_tagged(chunks, content, detect_size))


def read_capture_tagged(spark: SparkSession, path: str, glob: str = "*.cap", detect_size: bool = False) -> DataFrame:
    """Ticks and file outcomes of the capture chunks below ``path``, read once."""
    chunks = list_files(spark, path, glob)
    return decode_capture_tagged(ranges.spread(chunks.withColumn("offset", F.lit(0)), chunks), detect_size=detect_size)


def read_capture_chunks(spark: SparkSession, path: str, glob: str = "*.cap", verify: bool = False,
                        detect_size: bool = False) -> DataFrame:
    """Capture chunks below ``path``. ``verify`` leaves out chunks that fail a header check."""
    chunks = list_files(spark, path, glob)
    if verify:
        good = read_chunk_headers(spark, path, glob).where(F.col("status") == "ok")
        wanted = chunks.join(good.select("path"), "path", "left_semi")
    else:
        wanted = chunks
    wanted = ranges.spread(wanted.withColumn("offset", F.lit(0)), chunks)
    return decode_capture(wanted, detect_size=detect_size)


def payload_record_size(headers: DataFrame) -> DataFrame:
    """Guessed record size and number of records of each chunk."""
    size = record_size(F.col("uncompressed_len"))
    return headers.withColumn("record_size", size).withColumn(
        "records", F.call_function("div", F.col("uncompressed_len"), F.col("record_size")))
