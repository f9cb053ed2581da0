"""Encodes and decodes texts with reuse of content-defined chunks.

A rolling hash over the bytes cuts a text into chunks where its value meets a mask, so equal passages
are cut alike in every document. A task encodes each distinct chunk once. Chunk ends may lie inside a
word; a join is repaired by encoding the text around it again, from the last white space
before it to the first one after it, and wider until both ends agree with what the
neighbouring chunks say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickframe.llm import bpe
from tickframe.llm.tables import batches_of, map_arrow, texts
from tickframe.llm.words import spans, text_bytes

WINDOW = 8
MASK = (1 << 8) - 1  # a cut in 256 bytes on average
CACHE_CHUNKS = 60_000
_BATCH = 4 << 20
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, 256, np.uint32)


def cuts(data: np.ndarray, bounds: np.ndarray, mask: int = MASK) -> np.ndarray:
    """Starts of all chunks: every text's start, and wherever the hash of the last bytes meets the mask.

    A cut never splits a character, and depends on the ``WINDOW`` bytes before it alone.
    """
    at = bounds[:-1][np.diff(bounds) > 0]
    if len(data) <= WINDOW:
        return at
    gear = _GEAR[data]
    rolled = np.zeros(len(data) - WINDOW, np.uint32)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            rolled += gear[j:j + len(rolled)] << np.uint32(WINDOW - j)
    meets = ((rolled >> np.uint32(12)) & np.uint32(mask)) == 0
    found = np.flatnonzero(meets & ((data[WINDOW:] & 0xC0) != 0x80)) + WINDOW
    return np.union1d(at, found)


class ChunkEncoder:
    """Ids of whole texts from ids of chunks; keeps at most ``CACHE_CHUNKS`` chunks, then starts anew."""

    def __init__(self, tokenizer: str, mask: int = MASK):
        self.base = bpe.encoder(tokenizer)
        self.mask = mask
        self.known: dict[bytes, tuple] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        """For a chunk: ids of its inner words, and the bytes before its first and after its last white space."""
        heads, inner, tails = [], [], []
        texts_in = pa.array([c.decode() for c in chunks], pa.large_string())
        data, bounds = text_bytes(texts_in)
        starts, stops = spans(data, bounds)
        first = np.searchsorted(starts, bounds[:-1])
        upto = np.searchsorted(starts, bounds[1:])
        for k, chunk in enumerate(chunks):
            a, b, lo, hi = int(first[k]), int(upto[k]), int(bounds[k]), int(bounds[k + 1])
            if a == b:  # white space only
                heads.append(b""), inner.append(""), tails.append(b"")
                continue
            head = int(stops[a]) if starts[a] == lo else lo
            tail = int(starts[b - 1]) if stops[b - 1] == hi else hi
            if head == hi:  # one word without white space around it
                heads.append(None), inner.append(""), tails.append(None)
                continue
            heads.append(chunk[:head - lo])
            inner.append(chunk[head - lo:tail - lo].decode())
            tails.append(chunk[tail - lo:])
        ids, sizes = self.base.encode(pa.array(inner, pa.large_string()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for k, chunk in enumerate(chunks):
            self.known[chunk] = (heads[k], ids[ends[k]:ends[k + 1]].copy(), tails[k])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids per text."""
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        data, bounds = text_bytes(column)
        raw = data.tobytes()
        begin = cuts(data, bounds, self.mask)
        edges = np.append(begin, len(data)).tolist()
        chunks = [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]
        new = list({c for c in chunks if c not in self.known})
        if new:
            self._learn(new)
        per_text = np.diff(np.searchsorted(begin, bounds)).tolist()
        parts: list = []  # arrays of inner ids, and words at joins as bytes
        counts = np.zeros(len(per_text), np.int64)
        joins: list[bytes] = []
        k = 0
        for i, number in enumerate(per_text):
            before = len(parts)
            open_word = b""
            for chunk in chunks[k:k + number]:
                head, ids, tail = self.known[chunk]
                if head is None:
                    open_word += chunk  # the join is widened by a chunk without white space
                    continue
                word = open_word + head
                if word:
                    parts.append(len(joins))
                    joins.append(word)
                parts.append(ids)
                open_word = tail
            if open_word:
                parts.append(len(joins))
                joins.append(open_word)
            counts[i] = len(parts) - before
            k += number
        joined, sizes = self.base.encode(pa.array([j.decode() for j in joins], pa.large_string()))
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        parts = [joined[ends[p]:ends[p + 1]] if isinstance(p, int) else p for p in parts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        totals = np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), totals


def round_trip(docs: DataFrame, tokenizer: str = bpe.WORD, mask: int = MASK, keep: bool = False) -> DataFrame:
    """Ids of every text and what they decode to: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    With ``keep``, also ``ids`` (array) and ``decoded``. Null and empty texts have no ids. One row per
    row of ``docs``; a null ``doc_id`` stays null and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _chunk_encoder(tokenizer, mask)
        vocabulary = encoder.base.tokenizer
        names, numbers = _token_strings(tokenizer, vocabulary)
        for batch in batches_of(batches, _BATCH):
            ids, sizes = encoder.encode(batch.column("text"))
            bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            listed = ids.tolist()
            ids_sha, decoded_sha, texts_out, ids_out = [], [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = listed[a:b]
                decoded = " ".join([names[x] for x in own]) if names else vocabulary.decode(own, skip_special_tokens=False)
                ids_sha.append(hashlib.sha256(" ".join([numbers[x] for x in own]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    texts_out.append(decoded)
                    ids_out.append(own)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()),
                       pa.array(decoded_sha, pa.string())]
            fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts_out, pa.string())]
                fields += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, fields)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(texts(docs), run, schema + (", ids array<int>, decoded string" if keep else ""))


_chunk_encoders: dict[tuple[str, int], ChunkEncoder] = {}
_strings: dict[str, tuple] = {}


def _chunk_encoder(tokenizer: str, mask: int) -> ChunkEncoder:
    if (tokenizer, mask) not in _chunk_encoders:
        _chunk_encoders[tokenizer, mask] = ChunkEncoder(tokenizer, mask)
    return _chunk_encoders[tokenizer, mask]


def _token_strings(name: str, tokenizer) -> tuple[list[str] | None, list[str]]:
    """Text of each id where decoding is a join of tokens by spaces (the file has no decoder), and each id as text."""
    if name not in _strings:
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        names = [tokenizer.id_to_token(i) or "" for i in range(size)] if tokenizer.decoder is None else None
        _strings[name] = names, [str(i) for i in range(size)]
    return _strings[name]
