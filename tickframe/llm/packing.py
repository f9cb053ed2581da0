"""Packs documents into fixed-length training sequences with bounded-space best fit.

Every partition keeps a fixed number of open windows. A document's remainder below one sequence goes
into the open window it fills best. When none has room, the fullest is closed, and a new window
opens. Full sequences of long documents are closed at once. What is open at the end of a
partition is merged: leftovers of neighbouring partitions are laid end to end and cut anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import bpe
from tickframe.llm.tables import batches_of, map_arrow, texts, written

SEQUENCE = 2048
END_ID = 1
OPEN_WINDOWS = 64
# A window that closes with at least so much room takes the head of the piece that did not fit.
LEAST_CUT = 32
# Partitions whose leftovers are merged by one task.
MERGED = 16
_BATCH = 2 << 20

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, ids binary")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Windows:
    """Open windows of one partition; ``closed`` collects the pieces of closed ones."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.used = np.full(most, -1, np.int64)  # -1: not open
        self.pieces: list[list[tuple]] = [[] for _ in range(most)]
        self.closed: list[list[tuple]] = []

    def _close(self, k: int) -> None:
        self.closed.append(self.pieces[k])
        self.pieces[k] = []
        self.used[k] = -1

    def _put(self, k: int, doc: tuple, start: int, length: int) -> None:
        self.pieces[k].append((doc, start, length))
        self.used[k] = max(self.used[k], 0) + length
        if self.used[k] == self.size:
            self._close(k)

    def add(self, doc: tuple, total: int) -> None:
        start = 0
        while total - start >= self.size:
            self.closed.append([(doc, start, self.size)])
            start += self.size
        length = total - start
        if not length:
            return
        fits = (self.used >= 0) & (self.used + length <= self.size)
        if fits.any():
            self._put(int(np.argmax(np.where(fits, self.used, -1))), doc, start, length)
            return
        free = np.flatnonzero(self.used < 0)
        if len(free):
            self._put(int(free[0]), doc, start, length)
            return
        k = int(np.argmax(self.used))
        room = self.size - int(self.used[k])
        if room >= self.least_cut:
            self._put(k, doc, start, room)
            start, length = start + room, length - room
        else:
            self._close(k)
        self._put(k, doc, start, length)


def pack(docs: DataFrame, tokenizer: str = bpe.WORD, end_id: int = END_ID, size: int = SEQUENCE,
         open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, merged: int = MERGED) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``start`` counts the document's ids before the piece, ``offset`` those before it in its sequence.
    Sequences have at most ``size`` ids; every id of every document, ``end_id`` included, lies in
    exactly one piece. A null or empty text is its end id alone. Rows that share a ``doc_id`` are
    documents of their own, a null ``doc_id`` stays null, other columns are ignored, and an
    empty table gives no rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows = Windows(size, open_windows, least_cut)
        encoder = bpe.encoder(tokenizer)
        encode = encoder.encode
        count = 0

        def rows(groups: list[list[tuple]], is_open: bool) -> pa.RecordBatch:
            nonlocal count
            out: list[list] = [[] for _ in _FIELDS]
            for group in groups:
                offset = 0
                for (doc_id, total, ids), start, length in group:
                    own = ids[start:start + length]
                    values = (doc_id, start, length, _crc(own), total, -1 - part if is_open else part << 33 | count,
                              offset, own.astype("<u4").tobytes() if is_open else None)
                    for column, value in zip(out, values):
                        column.append(value)
                    offset += length
                count += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, _FIELDS)], [n for n, _ in _FIELDS])

        for batch in batches_of(batches, _BATCH):
            ids, sizes = encode(batch.column("text"))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end_id))
                windows.add((doc_id, len(own), own), len(own))
            yield rows(windows.closed, False)
            windows.closed = []
        yield rows([p for p in windows.pieces if p], True)
        encoder.release()  # the worker has other stages' work to do next

    # Sequence numbers of tasks must not change when some of them run again, so the pieces are kept.
    pieces = written(map_arrow(texts(docs), packed, _SCHEMA), "pieces")
    done = pieces.where(F.col("sequence_id") >= 0).drop("ids")
    left = (pieces.where(F.col("sequence_id") < 0).withColumn("part", -1 - F.col("sequence_id"))
            .withColumn("merge", F.floor(F.col("part") / merged)))
    return done.unionByName(_merge(left, size)).select(*[n for n, _ in _FIELDS[:-1]])


def _merge(left: DataFrame, size: int) -> DataFrame:
    """Lays the leftovers of each group of partitions end to end and cuts them into sequences.

    A group holds at most ``merged * open_windows`` pieces for each window's few documents.
    """
    order = Window.partitionBy("merge").orderBy("part", "offset", "doc_id", "start", "ids_crc32", "length")
    placed = left.withColumn("at", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("at", F.coalesce("at", F.lit(0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _FIELDS]
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u4")
                done = 0
                while done < len(ids):
                    at = row["at"] + done
                    take = min(len(ids) - done, size - at % size)
                    own = ids[done:done + take]
                    values = (row["doc_id"], row["start"] + done, take, _crc(own), row["doc_tokens"],
                              1 << 62 | row["merge"] << 33 | at // size, at % size, None)
                    for column, value in zip(out, values):
                        column.append(value)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, _FIELDS)], [n for n, _ in _FIELDS])

    return map_arrow(placed, cut, _SCHEMA).drop("ids")
