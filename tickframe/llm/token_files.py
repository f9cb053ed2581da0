"""Token ids as compressed binary blocks: canonical Huffman codes of limited length.

Layout of a written set, a folder:

- ``codes``: one row per id that occurs, with the length of its code. Codes follow from the lengths:
  by length, then by id.
- ``blocks``: one row per block with its file, its place there, its counts and its bytes. Files hold
  ascending ranges of ``doc_id``. A block can be decoded on its own.

Bytes of a block, little-endian: ``TKB1``, documents (u32), ids (u64), ids per checkpoint (u32),
checkpoints (u32); then ``doc_id`` (i64 each), null flags (u8 each), ids per document (u64 each),
the bit offset of each checkpoint (u64 each), and the codes as big-endian 64-bit words. Every
checkpoint starts a run that can be decoded by itself, so a block's runs are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.llm import bpe
from tickframe.llm.tables import batches_of, binary, lists, map_arrow, texts, written
from tickframe.sinks.shared import new_shared_path

MAGIC = b"TKB1"
LONGEST = 18
BLOCK_IDS = 1 << 16
STEP = 128
FILE_IDS = 4 << 20
_HEAD = struct.Struct("<4sIQII")
_BATCH = 4 << 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each symbol, by package-merge; 0 for symbols with count 0.

    ``longest`` is raised where so many symbols need longer codes.
    """
    present = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(present)
    if n < 2:
        out[present] = 1
        return out
    longest = max(longest, int(n - 1).bit_length())
    by_count = present[np.argsort(counts[present], kind="stable")]
    weights = counts[by_count].astype(np.int64)
    row, leaves = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = len(row) // 2
        both = np.concatenate([weights, row[0:2 * pairs:2] + row[1:2 * pairs:2]])
        order = np.argsort(both, kind="stable")
        row = both[order]
        leaves.append(order < n)
    take = 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        out[by_count[:own]] += 1
        take = 2 * (take - own)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, right-aligned."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    own = lengths[order]
    # Left-aligned to the longest code, codes are running sums of their shares of the code space.
    share = np.left_shift(np.int64(1), own[-1] - own)
    codes[order] = (np.cumsum(share) - share) >> (own[-1] - own)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and code length for every value of the next bits, and how many bits those are."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return np.zeros(2, np.uint32), np.ones(2, np.int64), 1
    own = lengths[order]
    bits = int(own[-1])
    share = np.left_shift(np.int64(1), bits - own)
    symbols = np.zeros(1 << bits, np.uint32)
    sizes = np.ones(1 << bits, np.int64)
    filled = int(share.sum())
    symbols[:filled] = np.repeat(order, share)
    sizes[:filled] = np.repeat(own, share)
    return symbols, sizes, bits


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Big-endian 64-bit words of the codes, and the bit offset of every ``step``-th id."""
    if not len(ids):
        return np.zeros(0, ">u8"), np.zeros(0, np.uint64)
    sizes = lengths[ids]
    upto = np.cumsum(sizes)
    at = upto - sizes
    word, shift = at >> 6, at & 63
    left = codes[ids] << (64 - sizes).astype(np.uint64)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out = np.zeros((int(upto[-1]) + 63) // 64 + 1, np.uint64)
    out[:len(begins)] = np.bitwise_or.reduceat(left >> shift.astype(np.uint64), begins)
    over = np.flatnonzero(shift + sizes > 64)
    out[word[over] + 1] |= left[over] << (64 - shift[over]).astype(np.uint64)
    return out[:(int(upto[-1]) + 63) // 64].astype(">u8"), at[::step].astype(np.uint64)


def unpack_bits(words: np.ndarray, checkpoints: np.ndarray, count: int, step: int, table) -> np.ndarray:
    """The ids; all checkpoints advance by one id at a time."""
    symbols, sizes, bits = table
    words = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
    at = checkpoints.astype(np.int64)
    out = np.empty((len(at), step), np.uint32)
    last = len(words) - 2
    for k in range(step):
        word = np.minimum(at >> 6, last)
        shift = (at & 63).astype(np.uint64)
        ahead = (words[word] << shift) | (words[word + 1] >> np.uint64(1) >> (np.uint64(63) - shift))
        slot = ahead >> np.uint64(64 - bits)
        out[:, k] = symbols[slot]
        at = at + sizes[slot]
    return out.ravel()[:count]


def write_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray,
                lengths: np.ndarray, step: int = STEP) -> bytes:
    words, checkpoints = pack_bits(ids, codes, lengths, step)
    return b"".join([
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), step, len(checkpoints)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        sizes.astype("<u8").tobytes(), checkpoints.astype("<u8").tobytes(), words.tobytes()])


def read_block(data: bytes, table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a block."""
    magic, docs, count, step, points = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    checkpoints = np.frombuffer(data, "<u8", points, at + 17 * docs)
    words = np.frombuffer(data, ">u8", -1, at + 17 * docs + 8 * points)
    ids = unpack_bits(words, checkpoints, count, step, table)
    return [None if n else int(d) for d, n in zip(doc_ids, null)], sizes, ids


def _tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bpe.encoder(tokenizer)
        kind = np.uint16 if max(base.tokenizer.get_vocab_size(), end_id) < 1 << 16 else np.uint32
        for batch in batches_of(batches, _BATCH):
            ids, sizes = base.encode(batch.column("text"))
            out = np.full(len(ids) + len(sizes), end_id, kind)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes + 1, pa.int64()), lists(out, sizes + 1)], ["doc_id", "n_tokens", "ids"])

    return map_arrow(texts(docs), run, "doc_id long, n_tokens long, ids binary")


def _width(n_tokens: np.ndarray, column: pa.Array):
    total = int(n_tokens.sum())
    import pyarrow.compute as pc

    return np.uint16 if not total or pc.sum(pc.binary_length(column)).as_py() == 2 * total else np.uint32


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all documents; at most one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.release_all()
        total = np.zeros(0, np.int64)
        for batch in batches_of(batches, _BATCH, "ids"):
            column = batch.column("ids")
            ids, _ = binary(column, _width(batch.column("n_tokens").to_numpy(), column))
            own = np.bincount(ids, minlength=len(total))
            own[:len(total)] += total
            total = own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return map_arrow(tokens, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str = bpe.BYTE, end_id: int = 0, longest: int = LONGEST,
          block_ids: int = BLOCK_IDS, step: int = STEP, file_ids: int = FILE_IDS) -> None:
    """Encodes all texts, ``end_id`` after each, and writes them to ``path`` in ascending ``doc_id`` order.

    Null ``doc_id`` come first; rows with equal ``doc_id`` are documents of their own, ordered by their
    ids. A null or empty text is its end id alone. An empty table gives empty files.
    """
    spark = docs.sparkSession
    tokens = written(_tokens(docs, tokenizer, end_id), "tokens")
    # One row per id of the vocabulary, which bounds what comes to the driver.
    counted = id_counts(tokens).collect()
    counts = np.zeros(max([r["id"] for r in counted], default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, longest)
    codes = canonical_codes(lengths)
    present = np.flatnonzero(lengths)
    (spark.createDataFrame([(int(i), int(lengths[i])) for i in present], "id long, length int")
     .coalesce(1).write.parquet(f"{path}/codes"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.release_all()
        file_id = TaskContext.get().partitionId()
        number = start = 0
        ids_open: list[np.ndarray] = []
        docs_open: list = []
        sizes_open: list[int] = []

        def block() -> pa.RecordBatch:
            nonlocal number, start, ids_open, docs_open, sizes_open
            ids = np.concatenate(ids_open)
            data = write_block(docs_open, np.array(sizes_open), ids, codes, lengths, step)
            out = pa.RecordBatch.from_pylist([{"file_id": file_id, "block": number, "start": start, "n_docs": len(docs_open),
                                               "n_tokens": len(ids), "data": data}])
            number, start = number + 1, start + len(ids)
            ids_open, docs_open, sizes_open = [], [], []
            return out

        pending = 0
        for batch in batches_of(batches, _BATCH, "ids"):
            column = batch.column("ids")
            sizes = batch.column("n_tokens").to_numpy()
            ids, _ = binary(column, _width(sizes, column))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids_open.append(ids[bounds[i]:bounds[i + 1]])
                docs_open.append(doc_id)
                sizes_open.append(int(sizes[i]))
                pending += int(sizes[i])
                if pending >= block_ids:
                    yield block()
                    pending = 0
        if docs_open:
            yield block()

    files = max(1, -(-int(counts.sum()) // file_ids))
    # Rows that agree in both columns are told apart by their ids, but within a file only: hashing all ids to
    # sample and to deal them out would cost more than the sort.
    order = ["doc_id", "n_tokens"]
    ordered = tokens.repartitionByRange(files, *order).sortWithinPartitions(*order, F.xxhash64("ids"))
    map_arrow(ordered, encode, "file_id long, block long, start long, n_docs long, n_tokens long, data binary"
              ).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of written files: ``doc_id, start, n_tokens, ids_crc32``, and ``ids`` if wanted.

    ``start`` is the number of ids of all documents before it. Blocks are decoded where they are read.
    """
    lengths_of = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/codes").collect()}
    lengths = np.zeros(max(lengths_of, default=-1) + 1, np.int64)
    lengths[list(lengths_of)] = list(lengths_of.values())
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per file.
    totals = blocks.groupBy("file_id").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tuple(lengths.tolist()))
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, sizes, ids = read_block(row["data"], table)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(row["before"] + row["start"] + bounds[:-1], pa.int64()),
                           pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return map_arrow(blocks.join(totals, "file_id").select("before", "start", "data"), decode, schema)


@lru_cache(maxsize=2)
def _table(lengths: tuple[int, ...]):
    return decoding_table(np.array(lengths, np.int64))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes token files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = new_shared_path(spark, "llm-token-files")
    write(docs, path, **options)
    return read(spark, path)
