"""Record borders of logs without sync marks, found in parallel.

A record says its own size only, so where the records of a block begin depends on all blocks before it.
Every block therefore answers for each offset at which a record may enter it: where the chain of records from there
leaves the block, and how many records begin on the way. These maps are computed independently, by pointer
doubling over small windows, and composed along each file. One huge log is walked by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import schemas as S
from tickframe.runtime import ship_package
from tickframe.sources import ranges

# name -> header bytes, place and width of the length field, bytes besides header and body (fixed values of the formats)
FORMATS = {
    "event": (S.EVENT_HEADER_BYTES, 5, 1, S.EVENT_TAIL_BYTES),
    "packet_v1": (S.PACKET_HEADER_BYTES_V1, 6, 2, 0),
    "packet_v2": (S.PACKET_HEADER_BYTES_V2, 10, 4, 0),
}
# Entry offsets that a block's map covers. Longer records than that are rare; a block that one of them enters deeper
# is walked when the maps are composed.
ENTRIES = 65_536 + S.PACKET_HEADER_BYTES_V2
_WINDOW = 1 << 16


def record_sizes(data: np.ndarray, kind: str) -> np.ndarray:
    """Size of the record at every place that has room for a header."""
    header, at, width, tail = FORMATS[kind]
    n = max(0, len(data) - header + 1)
    sizes = np.full(n, header + tail, np.int64)
    for k in range(width):
        sizes += data[at + k:at + k + n].astype(np.int64) << 8 * k
    return sizes


def record_starts(data: bytes, kind: str, entry: int = 0, until: int | None = None) -> tuple[np.ndarray, int]:
    """Places of the whole records from ``entry`` on that begin before ``until``, and where the last one ends."""
    header, field, width, tail = FORMATS[kind]
    at, last, fixed = entry, len(data) - header, header + tail
    stop = len(data) if until is None else until
    starts = []
    while at <= last and at < stop:
        end = at + fixed + (data[at + field] if width == 1 else int.from_bytes(data[at + field:at + field + width], "little"))
        if end > len(data):
            break
        starts.append(at)
        at = end
    return np.array(starts, np.int64), at


def _jumps(sizes: np.ndarray, begin: int, end: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in a window: where the chain from it leaves the window, and the records on the way.

    A place whose record is not whole is where its chain stops: it is left as ``-1 - place``.
    """
    place = np.arange(begin, end)
    sized = np.full(end - begin, np.iinfo(np.int64).max // 2)
    known = min(end, len(sizes)) - begin
    if known > 0:
        sized[:known] = sizes[begin:begin + known]
    to = place + sized
    count = np.ones(end - begin, np.int64)
    stops = to > room
    to[stops], count[stops] = -1 - place[stops], 0
    while True:
        inside = np.flatnonzero((to >= 0) & (to < end))
        if not len(inside):
            return to, count
        via = to[inside] - begin
        step, more = to[via], count[via]
        to[inside] = step
        count[inside] += more


def block_map(data: np.ndarray, block: int, room: int, kind: str, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """For the entry offsets of a block of ``block`` bytes: the exit, and the number of records that begin in between.

    ``data`` may go on behind the block, for headers across its end; ``room`` is how many bytes of the file follow
    the block's begin. An exit is an offset at or behind the block's end, or ``-1 - offset`` where the records stop.
    """
    sizes = record_sizes(data, kind)
    at = np.arange(min(entries, block))
    count = np.zeros(len(at), np.int64)
    for begin in range(0, block, _WINDOW):
        end = min(block, begin + _WINDOW)
        to, n = _jumps(sizes, begin, end, room)
        here = np.flatnonzero((at >= begin) & (at < end))
        slot = at[here] - begin
        at[here] = to[slot]
        count[here] += n[slot]
    return at, count


_MAP_BYTES = 4 << 20  # of maps, before they are handed to Spark


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all of them; ``_wide`` knows their number."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // n}") if n else np.zeros(0, np.int64)


_MAPPED = "path string, format string, length long, session_id string, chunk_index int, block long, size long, exits binary, counts binary"
_PIECE = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()), T.StructField("length", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("first_pos", T.LongType()), T.StructField("records", T.LongType())])


def block_maps(files: DataFrame, block_bytes: int, entries: int = ENTRIES) -> DataFrame:
    """The map of every block of ``files`` (session_id, chunk_index, path, format, length)."""
    header = max(h for h, *_ in FORMATS.values())
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("block")
    blocks = (files.where("length > 0").select("path", "format", "length", "session_id", "chunk_index", first)
              .withColumn("size", F.least(F.lit(block_bytes).cast("long"), F.col("length") - F.col("block"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ranges.RangeReader() as reader:
            for batch in batches:
                first, size, maps = 0, 0, []
                for k, row in enumerate(batch.to_pylist()):
                    room = row["length"] - row["block"]
                    data = np.frombuffer(reader.read(row["path"], row["block"], min(room, row["size"] + header)), np.uint8)
                    exits, counts = block_map(data, row["size"], room, row["format"], entries)
                    maps.append((_narrow(exits), _narrow(counts)))
                    size += len(maps[-1][0]) + len(maps[-1][1])
                    if size >= _MAP_BYTES or k == batch.num_rows - 1:
                        own = batch.slice(first, len(maps))
                        yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(list(m), pa.binary()) for m in zip(*maps)]],
                                                         [*own.schema.names, "exits", "counts"])
                        first, size, maps = k + 1, 0, []

    ship_package(files.sparkSession)
    # A task reads as much as another where each gets about a block's bytes.
    dealt = ranges.spread(blocks.withColumn("offset", F.col("block")), files, block_bytes).drop("offset")
    return dealt.select(*[c.split(" ")[0] for c in _MAPPED.split(", ")[:-2]]).mapInArrow(run, _MAPPED)


def pieces(files: DataFrame, block_bytes: int, entries: int = ENTRIES) -> DataFrame:
    """Runs of whole records, one for each block in which records begin, with the place of the first in its file.

    A file's maps are composed in order by one task: a lookup per block, whatever the block's size.
    """
    names = _PIECE.names

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, at, pos = None, 0, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.path != path:
                    path, at, pos = row.path, 0, 0
                entry = at - row.block
                if at < 0 or entry >= row.size:
                    continue  # the records stop before this block, or one covers it whole
                mapped = min(entries, row.size)
                if entry < mapped:
                    to, n = int(_wide(row.exits, mapped)[entry]), int(_wide(row.counts, mapped)[entry])
                else:
                    starts, end = _walked(row, at)
                    to, n = end - row.block, len(starts)
                    to = to if to >= row.size else -1 - to
                end = row.block + (to if to >= 0 else -1 - to)
                chunk = None if pd.isna(row.chunk_index) else int(row.chunk_index)
                if n:
                    out.append((row.session_id, chunk, row.path, row.format, row.length, at, end - at, pos, n))
                at, pos = (end if to >= 0 else -1), pos + n
            yield pd.DataFrame(out, columns=names).astype({"chunk_index": "Int32"})

    ordered = block_maps(files, block_bytes, entries).repartition("path").sortWithinPartitions("path", "block")
    return ordered.mapInPandas(compose, _PIECE)


def _walked(row, at: int) -> tuple[np.ndarray, int]:
    """Records from ``at`` to the block's end, header by header; bodies are not read."""
    header, field, width, tail = FORMATS[row.format]
    starts = []
    with ranges.open_file(row.path) as source:
        while at < row.block + row.size and at + header <= row.length:
            size = header + tail + int.from_bytes(source.read_at(header, at)[field:field + width], "little")
            if at + size > row.length:
                break
            starts.append(at)
            at += size
    return np.array(starts, np.int64), at
