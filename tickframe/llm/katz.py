"""A Katz backoff bigram model with Good-Turing discounts, learned from and applied to whole texts.

Every word is a symbol of its own, and every pair of words counts:

    P(w | h)    = d(c) c(h,w) / (c(h) + 1)   where the pair occurs in training
                = a(h) P(w)                  elsewhere
    P(w)        = (c(w) + 1/2) / (N + S/2)   for the S symbols: words, END, the unknown word and one that never occurs

``d`` are Good-Turing discounts of counts up to 5. ``a(h)`` makes the sum over all symbols exactly
one for every history; the one count added to ``c(h)`` and the symbol that never occurs keep it above
zero and finite.

Words of at least ``SHARE`` of the training tokens are at most ``1 / SHARE``: their counts and weights are broadcast. All other words
(rare ones) lie in the bucket of their hash with all their occurrences and the neighbours of each, so their count and those of
their pairs are known there: a pair of two words is counted by its second one if that is rare, else by the first. What a rare
history needs of pairs counted elsewhere (their counts of counts and lower-order mass) goes to its bucket in a second exchange,
together with the held-out occurrences that back off.

Tokens travel once: each chunk of documents sends its distinct pairs and rare words, with the documents they
occur in, to the bucket that counts them, and the bucket answers with sums per document. A history with
a large share of all tokens is spread over all buckets.

With ``share`` given, words below it share the symbol RARE in the pairs instead and are told apart inside it by their own counts:

    P(x | RARE) = r(c) c(x) / (C + 1)        for known rare words; the rest goes to the unknown word
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.tables import batches_of, by_bucket, lists, map_arrow, texts, training_row, written

SHARE = 1e-5
HOT = 5e-4  # histories of a larger share of all tokens are spread over the buckets
TOP = 5  # counts above are not discounted
BUCKET_TOKENS = 1_000_000
_ANSWER_BYTES = 4 << 20
_BATCH = 8 << 20
_ROWS = 30_000  # documents of a chunk; their numbers and the training flag share 16 bits
_TRAIN = np.uint16(1 << 15)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, _BATCH):
        for a in range(0, batch.num_rows, _ROWS):
            yield batch.slice(a, _ROWS)


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and their number per text."""
    data, bounds = words.text_bytes(batch.column("text"))
    data = words.lower(data)
    starts, ends = words.spans(data, bounds)
    return words.hash_spans(data, starts, ends), words.counts_per_text(starts, bounds)


def _marked(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return texts(docs, training_row(modulus, held_out).alias("train"))


def unigrams(docs: DataFrame, modulus: int, held_out: int, buckets: int) -> DataFrame:
    """``bucket, words, counts``: training counts of all words by hash, packed per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            hashes, number = _hashed(batch)
            use = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), number)
            found, n = np.unique(hashes[use], return_counts=True)
            bucket = (found % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=buckets)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), lists(found[order], sizes),
                                              lists(n[order].astype(np.uint32), sizes)], ["bucket", "words", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            found, back = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), return_inverse=True)
            n = np.bincount(back, np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]), len(found))
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "words": found.tobytes(), "counts": n.astype(np.int64).tobytes()}],
                                             pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))

    schema = "bucket int, words binary, counts binary"
    parts = map_arrow(_marked(docs, modulus, held_out), count, schema).where(F.length("words") > 0)
    return map_arrow(parts.repartition(buckets, "bucket").sortWithinPartitions("bucket"), merge, schema)


def _stats(table: DataFrame, least: float | None) -> DataFrame:
    """Of the unigram table: tokens, types, types by count up to 6, and the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, n = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.int64)
                low = np.bincount(n[n <= TOP + 1], minlength=TOP + 2)
                top = n >= least if least is not None else np.zeros(len(n), bool)
                yield pa.RecordBatch.from_pylist(
                    [{"n": int(n.sum()), "v": len(n), "low": low.tolist(), "words": found[top].tobytes(), "counts": n[top].tobytes()}],
                    pa.schema([("n", pa.int64()), ("v", pa.int64()), ("low", pa.list_(pa.int64())), ("words", pa.binary()),
                               ("counts", pa.binary())]))

    return map_arrow(table, run, "n long, v long, low array<long>, words binary, counts binary")


def discounts(low: np.ndarray) -> np.ndarray:
    """Good-Turing discount factors of the counts 0..5, from the numbers of types by count up to 6.

    Where the numbers give no factor in (0, 1], a count loses one half.
    """
    out = np.ones(TOP + 1)
    n = low.astype(np.float64)
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for c in range(1, TOP + 1):
        out[c] = (c - 0.5) / c
        if n[c] and n[1] and common < 1:
            own = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common)
            if 0 < own <= 1:
                out[c] = own
    return out


class Symbols:
    """The symbols of a model and their training counts; broadcast to the tasks."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, texts_: int, types: int | None = None):
        """``types``: number of training words, if every word is a symbol of its own."""
        order = np.argsort(hashes)
        self.hashes, frequent = hashes[order], counts[order]
        self.rare, self.end, self.start, self.size = len(hashes), len(hashes) + 1, len(hashes) + 2, len(hashes) + 3
        self.rare_tokens = tokens - int(frequent.sum())
        # As a history RARE, END and START count too; END never is one, START never follows.
        self.counts = np.concatenate([frequent, [self.rare_tokens, texts_, texts_]])
        total = tokens + texts_
        self.whole = types is not None
        self.mass = total + 0.5 * (types + 3 if self.whole else self.size)
        self.log_p = np.log10((self.counts + 0.5) / self.mass)
        self.log_p[self.start] = np.log10(0.5 / self.mass)  # START's place: the symbol that never occurs
        self.tags = np.concatenate([self.hashes, np.arange(3, dtype=np.uint64)])  # names of symbols beside hashes of rare words
        self.hot = self.counts > HOT * max(total, 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not self.rare:
            return np.full(len(hashes), self.rare, np.int64)
        slot = np.minimum(np.searchsorted(self.hashes, hashes), self.rare - 1)
        return np.where(self.hashes[slot] == hashes, slot, self.rare)


def _deltas(keys: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ascending runs as steps, of 4 bytes each where all of a run fit, else of 8."""
    out, at = [], 0
    for n in sizes.tolist():
        own = np.diff(keys[at:at + n], prepend=np.uint64(0))
        out.append((own.astype(np.uint32) if n and own.max() < 1 << 32 else own).tobytes())
        at += n
    return pa.array(out, pa.binary())


def _undelta(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.uint64).astype(np.uint64))


def _small(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Counts in 1 byte each where all of a run fit, else 4."""
    out, at = [], 0
    for n in sizes.tolist():
        own = values[at:at + n]
        out.append((own.astype(np.uint8) if n and own.max() < 256 else own.astype(np.uint32)).tobytes())
        at += n
    return pa.array(out, pa.binary())


_SENT = "bucket int, kind int, chunk long, n int, keys binary, counts binary, docs binary, near binary"
_FIELDS = ["bucket", "kind", "chunk", "n", "keys", "counts", "docs", "near"]
_DOC, _RARE, _PAIR, _HISTORY, _TYPES, _OWN, _OTHER, _OFF, _FIX = range(9)


def _grouped(keys: np.ndarray, docs: np.ndarray, bucket: np.ndarray, buckets: int, kind: int, chunk: int,
             near: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    """One row per bucket: its distinct keys, how often each occurs, and the documents of the occurrences.

    ``near``: symbols before and after each occurrence, and the hash of a rare word before it.
    """
    order = np.lexsort((keys, bucket)) if kind == _RARE else np.argsort(bucket.astype(np.uint64) << np.uint64(42) | keys, kind="stable")
    keys, docs, bucket = keys[order], docs[order], bucket[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(first)
    distinct = np.bincount(bucket[at], minlength=buckets)
    number = np.bincount(bucket, minlength=buckets)
    many = np.diff(np.append(at, len(keys)))
    beside = [b""] * buckets
    if near is not None:
        before, after, hashes, is_rare = (x[order] for x in near)
        ends = np.cumsum(number)
        beside = [before[a:b].tobytes() + after[a:b].tobytes() + hashes[a:b][is_rare[a:b]].tobytes()
                  for a, b in zip((ends - number).tolist(), ends.tolist())]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(buckets), pa.int32()), pa.array(np.full(buckets, kind), pa.int32()), pa.array(np.full(buckets, chunk)),
         pa.array(distinct, pa.int32()), _deltas(keys[at], distinct), _small(many, distinct), lists(docs, number),
         pa.array(beside, pa.binary())], _FIELDS)
    return batch.filter(pa.array(distinct > 0))


def _send(docs: DataFrame, symbols, buckets: int, modulus: int, held_out: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Symbols = symbols.value
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(_chunks(batches)):
            chunk = part << 24 | number
            hashes, counts = _hashed(batch)
            n = len(counts)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            owner = np.arange(n, dtype=np.uint16) | np.where(train, _TRAIN, np.uint16(0))
            own = known.of(hashes)
            each = np.repeat(owner, counts)
            rare = own == known.rare
            at_bucket = (hashes[rare] % np.uint64(buckets)).astype(np.int64)
            if not known.whole:
                yield _grouped(hashes[rare], each[rare], at_bucket, buckets, _RARE, chunk)
            # Every text is START, its words, END; pairs are neighbours.
            at = np.arange(len(own)) + 2 * np.repeat(np.arange(n), counts) + 1
            row = np.full(len(own) + 2 * n, known.end, np.int64)
            row[at] = own
            begins = np.concatenate([[0], np.cumsum(counts + 2)])[:-1]
            row[begins] = known.start
            follows = np.ones(len(row), bool)
            follows[begins] = False
            history, word = row[:-1][follows[1:]], row[1:][follows[1:]]
            pair_docs = np.repeat(owner, counts + 1)
            del follows
            if known.whole:
                name = np.zeros(len(row), np.uint64)
                name[at] = hashes
                own_at = at[rare]
                before = row[own_at - 1]
                yield _grouped(hashes[rare], each[rare], at_bucket, buckets, _RARE, chunk,
                               (before.astype(np.uint32), row[own_at + 1].astype(np.uint32), name[own_at - 1], before == known.rare))
                del name, own_at, before
                both = (history != known.rare) & (word != known.rare)
                history, word, pair_docs = history[both], word[both], pair_docs[both]
                del both
            del hashes, each, at_bucket, at, row  # what is done with goes before the next sort, as a chunk's arrays are large
            keys = (history * known.size + word).astype(np.uint64)
            spread = np.where(known.hot[history], words.mix(keys), words.mix(history.astype(np.uint64)))
            del history, word
            yield _grouped(keys, pair_docs, (spread % np.uint64(buckets)).astype(np.int64), buckets, _PAIR, chunk)
            del keys, spread, pair_docs
            # What a document's own frequent words add to the base score needs no bucket.
            frequent = np.concatenate([known.counts[:known.rare].astype(np.float64), [np.nan]])[own]
            base = np.bincount(np.repeat(np.arange(n), counts), np.where(rare, 0, np.log10(np.where(rare, 1, frequent) + 0.5)), n)
            base = base.astype(np.float64) + np.log10(known.counts[known.end] + 0.5)  # of no words, sums are integers
            seen = np.bincount(np.repeat(np.arange(n), counts), ~rare, n) + (known.counts[known.end] > 0)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk % buckets], pa.int32()), pa.array([_DOC], pa.int32()), pa.array([chunk]), pa.array([n], pa.int32()),
                 pa.array([np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), counts + 1,
                                     seen.astype(np.int64)]).astype(np.int64).tobytes()], pa.binary()),
                 pa.array([base.tobytes()], pa.binary()), pa.array([train.astype(np.uint8).tobytes()], pa.binary()),
                 pa.array([b""], pa.binary())], _FIELDS)

    return map_arrow(_marked(docs, modulus, held_out), run, _SENT)


def _occurrences(rows: list[dict]) -> tuple:
    """Distinct keys of all rows, training count of each, and per row: places of its keys, occurrences per key, documents."""
    unpacked = []
    for row in rows:
        docs = np.frombuffer(row["docs"], np.uint16)
        n = row["n"]
        many = np.frombuffer(row["counts"], np.uint8 if len(row["counts"]) == n else np.uint32).astype(np.int64)
        unpacked.append((_undelta(row["keys"], n), many, docs))
    keys, back = np.unique(np.concatenate([u[0] for u in unpacked]), return_inverse=True)
    train = np.concatenate([np.add.reduceat((d >= _TRAIN).astype(np.int64), np.cumsum(m) - m) for _, m, d in unpacked])
    counts = np.bincount(back, train, len(keys)).astype(np.int64)
    ends = np.cumsum([len(u[0]) for u in unpacked])
    return keys, counts, [(back[b - len(k):b], m, d & (_TRAIN - np.uint16(1))) for b, (k, m, d) in zip(ends.tolist(), unpacked)]


_ANSWER = "bucket int, kind int, chunk long, docs binary, sums binary, low binary, more binary"
_ANSWER_FIELDS = ["bucket", "kind", "chunk", "docs", "sums", "low", "more"]
_ANSWER_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()),
                            *[(f, pa.binary()) for f in _ANSWER_FIELDS[3:]]])


def _row(kind: int, chunk: int, docs, sums=b"", low=b"", more=b"", bucket: int = 0) -> dict:
    return {"bucket": bucket, "kind": kind, "chunk": chunk, **{n: v if isinstance(v, bytes) else np.ascontiguousarray(v).tobytes()
            for n, v in (("docs", docs), ("sums", sums), ("low", low), ("more", more))}}


def _packed(rows: Iterator[dict], size: int = _ANSWER_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes, so that neither side holds all answers of a bucket at once."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += sum(len(row[n]) for n in _ANSWER_FIELDS[3:])
        if held >= size:
            yield pa.RecordBatch.from_pylist(some, _ANSWER_SCHEMA)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, _ANSWER_SCHEMA)


def _narrow(low: np.ndarray) -> np.ndarray:
    return low.astype(np.uint16 if not low.size or low.max() < 1 << 16 else np.uint32)


def _by_count(place: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place * (TOP + 2) + low, minlength=n * (TOP + 2)).reshape(n, TOP + 2)


def _per_history(h: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> dict:
    """Per history symbol: types by count, the tokens of its seen pairs, and the lower-order mass of the seen words."""
    found, place = np.unique(h, return_inverse=True)
    return _row(_HISTORY, 0, found.astype(np.int64), low=_by_count(place, np.minimum(counts, TOP + 2) - 1, len(found)).astype(np.int64),
                sums=np.stack([np.bincount(place, counts, len(found)), np.bincount(place, mass, len(found))]))


def _dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the hashes of each bucket."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        if end > start:
            yield b, order[start:end]


def _rare_answers(rows: list[dict], known: Symbols, buckets: int) -> Iterator[dict]:
    """Of all occurrences of the rare words of a bucket: their part of the scores, and what rare histories need elsewhere.

    A word counts the pairs it ends, and those it begins before a frequent symbol. As a history it brings each of its
    occurrences ``-log10(c + 1)``; pairs that back off take that back by the second exchange.
    """
    keys, counts, own = _occurrences(rows)
    x = np.concatenate([np.repeat(at, many) for at, many, _ in own])
    docs = np.concatenate([d for _, _, d in own])
    train = np.concatenate([np.frombuffer(r["docs"], np.uint16) >= _TRAIN for r in rows])
    sizes = [len(d) for _, _, d in own]
    before = np.concatenate([np.frombuffer(r["near"], np.uint32, n) for r, n in zip(rows, sizes)]).astype(np.int64)
    after = np.concatenate([np.frombuffer(r["near"], np.uint32, n, 4 * n) for r, n in zip(rows, sizes)]).astype(np.int64)
    old = before == known.rare
    name = known.tags[before]
    name[old] = np.concatenate([np.frombuffer(r["near"], np.uint64, -1, 8 * n) if len(r["near"]) > 8 * n else np.zeros(0, np.uint64)
                                for r, n in zip(rows, sizes)])
    log_p = np.log10((counts + 0.5) / known.mass)
    # Pairs that end with the word, and those that begin with it and go on with a frequent symbol.
    with np.errstate(over="ignore"):
        _, first, ends = np.unique(words.mix(name + words.mix(keys[x])), return_index=True, return_inverse=True)
    n_end = np.bincount(ends, train, len(first)).astype(np.int64)
    plain = np.flatnonzero(after != known.rare)
    pairs, begins = np.unique(x[plain] * known.size + after[plain], return_inverse=True)
    n_begin = np.bincount(begins, train[plain], len(pairs)).astype(np.int64)
    h_begin, w_begin = pairs // known.size, pairs % known.size
    # Occurrences.
    c_end, c_begin = n_end[ends], n_begin[begins]
    value = np.where(c_end > 0, np.log10(np.maximum(c_end, 1)), log_p[x]) - np.log10(counts[x] + 1)
    value -= np.where(~old & (c_end > 0), np.log10(known.counts[before] + 1), 0)
    value[plain] += np.where(c_begin > 0, np.log10(np.maximum(c_begin, 1)), known.log_p[after[plain]])
    off_old, off_plain = np.flatnonzero(old & (c_end == 0)), plain[c_begin == 0]
    upto = np.cumsum(sizes)
    for row, a, b in zip(rows, (upto - sizes).tolist(), upto.tolist()):
        chunk = row["chunk"]
        met, place = np.unique(docs[a:b], return_inverse=True)
        word_low = _by_count(place, np.minimum(counts[x[a:b]], TOP + 1), len(met))
        yield _row(_RARE, chunk, met, np.zeros(len(met)), _narrow(word_low),
                   np.bincount(place, np.log10(counts[x[a:b]] + 0.5), len(met)))
        p, q = np.searchsorted(plain, [a, b])
        low = _by_count(place, np.minimum(c_end[a:b], TOP + 1), len(met))
        low += _by_count(place[plain[p:q] - a], np.minimum(c_begin[p:q], TOP + 1), len(met))
        off = a + np.flatnonzero(~old[a:b] & (c_end[a:b] == 0))
        yield _row(_PAIR, chunk, met, np.bincount(place, value[a:b], len(met)), _narrow(low),
                   docs[off].tobytes() + before[off].astype(np.uint32).tobytes())
    # Of all chunks at once: a row for each bucket that the histories lie in.
    off = np.concatenate([off_old, off_plain])
    order = np.argsort(off, kind="stable")
    h = np.concatenate([name[off_old], keys[x[off_plain]]])[order]
    chunk_of = np.repeat(np.array([r["chunk"] for r in rows], np.int64), sizes)
    for bucket, at in _dealt(h, buckets):
        own = off[order[at]]
        yield _row(_OFF, 0, docs[own], h[at], more=chunk_of[own], bucket=bucket)
    # Histories: frequent ones, rare ones of other buckets, and the bucket's own.
    seen = n_end > 0
    at, n_seen = first[seen], n_end[seen]
    mass = 10 ** log_p[x[at]]
    frequent = ~old[at]
    yield _per_history(before[at[frequent]], n_seen[frequent], mass[frequent])
    at, n_seen = at[~frequent], n_seen[~frequent]
    types = np.bincount(np.minimum(n_seen, TOP + 2) - 1, minlength=TOP + 2)
    for bucket, some in _dealt(name[at], buckets):
        yield _row(_OTHER, 0, name[at[some]], np.minimum(n_seen[some], TOP + 2).astype(np.uint8), counts[x[at[some]]].astype(np.uint32), bucket=bucket)
    seen = n_begin > 0
    low = _by_count(h_begin[seen], np.minimum(n_begin[seen], TOP + 2) - 1, len(keys))
    mass = np.bincount(h_begin[seen], 10 ** known.log_p[w_begin[seen]], len(keys))
    yield _row(_TYPES, 0, (types + low.sum(axis=0)).astype(np.int64))
    # Only words that training and held-out texts share ever back off with a weight.
    use = (counts > 0) & (np.bincount(x[~train], minlength=len(keys)) > 0)
    for bucket, some in _dealt(keys[use], buckets):
        yield _row(_OWN, 0, keys[use][some], mass[use][some], low[use][some].astype(np.int64), counts[use][some], bucket=bucket)


def _weights(answers: DataFrame, symbols, d: np.ndarray, buckets: int) -> DataFrame:
    """Per chunk: what the pairs that back off from rare histories add to the scores of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Symbols = symbols.value
        lost_of = np.concatenate([(1 - d[1:]) * np.arange(1, TOP + 1), [0, 0]])
        for _, rows in by_bucket(batches):
            own = [r for r in rows if r["kind"] == _OWN]
            if not own:
                continue
            read = lambda rows, name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
            h = read(own, "docs", np.uint64)
            order = np.argsort(h)
            h, mass, counts = h[order], read(own, "sums", np.float64)[order].copy(), read(own, "more", np.int64)[order]
            lost = read(own, "low", np.int64).reshape(-1, TOP + 2)[order] @ lost_of

            def place(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                return at, h[at] == hashes

            for r in rows:
                if r["kind"] == _OTHER:
                    at, known_here = place(np.frombuffer(r["docs"], np.uint64))
                    at = at[known_here]
                    lost += np.bincount(at, lost_of[np.frombuffer(r["sums"], np.uint8)[known_here] - 1], len(h))
                    mass += np.bincount(at, (np.frombuffer(r["low"], np.uint32)[known_here] + 0.5) / known.mass, len(h))
            left = 1 - (counts - lost) / (counts + 1)
            weight = np.log10(left / (1 - np.minimum(mass, 1 - 10 ** known.log_p[known.start]))) + np.log10(counts + 1)
            off = [r for r in rows if r["kind"] == _OFF]
            if off:
                at, known_here = place(read(off, "sums", np.uint64))
                docs, chunks = read(off, "docs", np.uint16)[known_here], read(off, "more", np.int64)[known_here]
                gain = weight[at[known_here]]
                order = np.argsort(chunks, kind="stable")
                docs, chunks, gain = docs[order], chunks[order], gain[order]
                cuts = np.flatnonzero(np.diff(chunks)) + 1
                parts = zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunks)]) if len(chunks) else ()
                met = ((a, b, *np.unique(docs[a:b], return_inverse=True)) for a, b in parts)
                yield from _packed(_row(_FIX, int(chunks[a]), own, np.bincount(slot, gain[a:b], len(own))) for a, b, own, slot in met)

    some = answers.where(F.col("kind").isin(_OWN, _OTHER, _OFF))
    return map_arrow(some.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, _ANSWER)


def _answers(rows: list[dict], kind: int, known: Symbols) -> Iterator[dict]:
    """Per chunk: documents met, the sum of logarithms that counts give, tokens by low count, and pairs to back off.

    Tokens by training count: 0 to 5, and above. For rare words ``more`` is their part of the base score.
    """
    keys, counts, own = _occurrences(rows)
    history = (keys // np.uint64(known.size)).astype(np.int64) if kind == _PAIR else None
    word = (keys % np.uint64(known.size)).astype(np.int64) if kind == _PAIR else None
    seen = counts > 0
    value = np.log10(np.maximum(counts, 1))
    if kind == _PAIR:
        value = np.where(seen, value - np.log10(known.counts[history] + 1), known.log_p[word])
    else:
        value = np.where(seen, value - np.log10(known.rare_tokens + 1), 0.0)
    low_of = np.where(counts <= TOP, counts, TOP + 1)
    base = np.log10(counts + 0.5)
    for row, (at, many, docs) in zip(rows, own):
        at = np.repeat(at, many)
        met, place = np.unique(docs, return_inverse=True)
        sums = np.bincount(place, value[at], len(met))
        low = np.bincount(place * (TOP + 2) + low_of[at], minlength=len(met) * (TOP + 2)).reshape(len(met), TOP + 2)
        if kind == _PAIR:
            off = ~seen[at]
            more = docs[off].tobytes() + history[at[off]].astype(np.uint32).tobytes()
        else:
            more = np.bincount(place, base[at], len(met)).tobytes()
        yield _row(kind, row["chunk"], met, sums, _narrow(low), more)
    if kind == _PAIR:
        yield _per_history(history[seen], counts[seen], 10 ** known.log_p[word[seen]])


def _count(sent: DataFrame, symbols, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Symbols = symbols.value

        def answers(rows: list[dict]) -> Iterator[dict]:
            yield from (_row(_DOC, r["chunk"], r["keys"], r["counts"], r["docs"]) for r in rows if r["kind"] == _DOC)
            for kind in (_RARE, _PAIR):
                own = [r for r in rows if r["kind"] == kind]
                if own:
                    yield from _rare_answers(own, known, buckets) if kind == _RARE and known.whole else _answers(own, kind, known)

        for _, rows in by_bucket(batches):
            yield from _packed(answers(rows))

    return map_arrow(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk"), run, _ANSWER)


def _histories(answers: DataFrame) -> DataFrame:
    """``history, low (types by count), tokens, mass``, one row per symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = np.frombuffer(row["docs"], np.int64)
                low = np.frombuffer(row["low"], np.int64).reshape(len(h), TOP + 2)
                tokens, mass = np.frombuffer(row["sums"], np.float64).reshape(2, len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), *[pa.array(np.ascontiguousarray(low[:, k])) for k in range(TOP + 1)], pa.array(tokens), pa.array(mass)],
                    ["history", *[f"n{k + 1}" for k in range(TOP + 1)], "tokens", "mass"])

    columns = [f"n{k + 1}" for k in range(TOP + 1)]
    rows = map_arrow(answers.where(F.col("kind") == _HISTORY), run,
                     "history long, " + ", ".join(f"{c} long" for c in columns) + ", tokens double, mass double")
    return rows.groupBy("history").agg(*[F.sum(c).alias(c) for c in [*columns, "tokens", "mass"]])


def backoff(known: Symbols, histories: list, d: np.ndarray) -> np.ndarray:
    """log10 of the backoff weight of every symbol as a history; 0 (weight one) for those never seen as one."""
    out = np.zeros(known.size)
    for r in histories:
        lost = sum((1 - d[c]) * c * r[f"n{c}"] for c in range(1, TOP + 1))
        left = 1 - (r["tokens"] - lost) / (known.counts[r["history"]] + 1)
        out[r["history"]] = np.log10(left / (1 - min(r["mass"], 1 - 10 ** known.log_p[known.start])))
    return out


def score(docs: DataFrame, modulus: int = 5, held_out: int = 1, share: float | None = None, symbol_share: float = SHARE) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per row of ``docs``.

    Training leaves out rows with ``crc32(doc_id) % modulus == held_out``; rows with a null ``doc_id`` train.
    A null or empty text is its end alone. Repeated rows count as often as they occur; other columns
    are ignored; an empty table gives no rows. ``score`` is the model's log10 probability of the
    text, ``base_score`` that of add-one-half unigrams with one unknown word. Words below ``share``, when given, are merged in
    pairs; ``symbol_share`` says which words are broadcast otherwise, and changes no result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = written(unigrams(docs, modulus, held_out, parts), "unigrams")
    totals = _stats(table, None).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(training_row(modulus, held_out)).count()
    words_, types = totals["n"] or 0, totals["v"] or 0
    tokens = words_ + texts_
    stats = _stats(table, max(1.0, (symbol_share if share is None else share) * tokens))
    # Words of at least ``share`` of all tokens: not more than 1 / share.
    top = stats.where(F.length("words") > 0).select("words", "counts").collect()
    low = stats.select(*[F.sum(F.get("low", F.lit(k))).alias(f"n{k}") for k in range(TOP + 2)]).first()
    frequent = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in top]) if top else np.zeros(0, np.uint64)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in top]) if top else np.zeros(0, np.int64)
    known = Symbols(frequent, counts, words_, texts_, types if share is None else None)
    rare_low = np.array([(low[f"n{k}"] or 0) - int((counts == k).sum()) for k in range(TOP + 2)])
    r = discounts(rare_low)
    rare_lost = sum((1 - r[c]) * c * rare_low[c] for c in range(1, TOP + 1))
    r_log = np.zeros(TOP + 1) if share is None else np.log10(np.concatenate([[(rare_lost + 1) / (known.rare_tokens + 1)], r[1:]]))
    symbols = spark.sparkContext.broadcast(known)
    buckets = max(parts, -(-tokens // BUCKET_TOKENS))
    answers = written(_count(_send(docs, symbols, buckets, modulus, held_out), symbols, buckets), "pairs")
    histories = _histories(answers).collect()  # one row per symbol at most
    other = answers.where(F.col("kind") == _TYPES).select("docs").collect()  # one small row per bucket
    other = sum((np.frombuffer(t["docs"], np.int64) for t in other), np.zeros(TOP + 2, np.int64))
    d = discounts(np.array([0] + [sum(h[f"n{k}"] for h in histories) + int(other[k - 1]) for k in range(1, TOP + 2)]))
    weights = spark.sparkContext.broadcast(backoff(known, histories, d))
    d_log = np.concatenate([[0.0], np.log10(d[1:])])
    log_total = float(np.log10(tokens + 0.5 * (types + (texts_ > 0) + 1)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = weights.value

        def rows(chunk: list[dict]) -> pa.RecordBatch:
            head = next(r for r in chunk if r["kind"] == _DOC)
            ids, null, n_tokens, n_known = np.frombuffer(head["docs"], np.int64).reshape(4, -1)
            n_known, base = n_known.copy(), np.frombuffer(head["sums"]).copy()
            train = np.frombuffer(head["low"], np.uint8)
            total = np.zeros(len(ids))
            for r in chunk:
                if r["kind"] == _DOC:
                    continue
                met = np.frombuffer(r["docs"], np.uint16)
                if r["kind"] == _FIX:
                    total[met] += np.frombuffer(r["sums"])
                    continue
                number = np.frombuffer(r["low"], np.uint16 if len(r["low"]) == 2 * (TOP + 2) * len(met) else np.uint32)
                number = number.reshape(len(met), TOP + 2).astype(np.float64)
                total[met] += np.frombuffer(r["sums"]) + number[:, :TOP + 1] @ (d_log if r["kind"] == _PAIR else r_log)
                if r["kind"] == _PAIR:
                    off = len(r["more"]) // 6
                    where = np.frombuffer(r["more"], np.uint16, off)
                    total += np.bincount(where, a[np.frombuffer(r["more"], np.uint32, off, 2 * off)], len(ids))
                else:
                    base[met] += np.frombuffer(r["more"])
                    n_known[met] += number[:, 1:].sum(axis=1).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null.astype(bool)), pa.array(train == 0), pa.array(n_tokens), pa.array(n_known),
                 pa.array(base - n_tokens * log_total), pa.array(total)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for _, chunk in by_bucket(batches, "chunk"):
            yield rows(chunk)

    own = answers.where(F.col("kind").isin(_DOC, _RARE, _PAIR))
    if share is None:
        own = own.unionByName(_weights(answers, symbols, d, buckets))
    own = own.repartition("chunk").sortWithinPartitions("chunk", "kind")
    out = map_arrow(own, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
