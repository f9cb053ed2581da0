"""Removes passages that repeat across documents.

A paragraph is a line. Paragraphs of ``LINE_WORDS`` words or more are compared by sets of five-word
shingles: MinHash bands collide, colliding paragraphs form clusters, and exact Jaccard similarity
inside a cluster makes components. A passage that sits inside longer lines is met by its sentences: those of
``SENTENCE_WORDS`` words or more are classes of equal words. Of every class that covers two documents, the
occurrence with the least (doc_id, place) stays and the others go.

With ``BANDS`` bands of ``ROWS`` rows, two paragraphs of similarity 0.8 collide with a probability of
1 - (1 - 0.8**3)**10, above 0.999.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.components import connected_components
from tickframe.llm.key_filter import key_bitmap, may_match
from tickframe.llm.near_dups import PERCENT, SHINGLE, confirm, distinct_sets, signatures, sized, vertex_of
from tickframe.llm.tables import batches_of, binary, dealt, lists, map_arrow, tasks_for, texts, unused_names, written

BANDS = 10
ROWS = 3
LINE_WORDS = 16
SENTENCE_WORDS = 8
_BATCH = 2 << 20
_TASK_UNITS = 1 << 16
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]")
LINE, SENTENCE = 0, 1


def _groups(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs that ``first`` marks."""
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, n))


def _pieces(column: pa.Array):
    """Words of a batch in their lines and sentences: hashes, byte spans, owning text, and both kinds of runs."""
    data, bounds = words.text_bytes(column)
    starts, ends = words.spans(data, bounds)
    hashes = words.hash_spans(words.lower(data), starts, ends)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new_line = np.ones(len(starts), bool)
    new_line[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    new_sentence = new_line.copy()
    new_sentence[1:] |= _STOPS[data[ends[:-1] - 1]]
    return hashes, starts - bounds[owner], ends - bounds[owner], owner, new_line, new_sentence


def _picked(values: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The values of runs that begin at ``at``, in a row."""
    upto = np.cumsum(number)
    return values[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(at - upto + number, number)]


def _lines(hashes, new_line, least: int):
    at, number = _groups(new_line, len(hashes))
    long = number >= least
    at, number = at[long], number[long]
    sets, sizes = distinct_sets(*words.shingles(_picked(hashes, at, number), number, SHINGLE))
    return at, number, sets, sizes


def _band_keys(marks: np.ndarray, bands: int) -> np.ndarray:
    """One key per paragraph and band."""
    keys = np.empty((len(marks), bands), np.uint64)
    rows = marks.shape[1] // bands
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(marks), b + 1, np.uint64)
            for r in range(rows):
                key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + marks[:, b * rows + r].astype(np.uint64))
            keys[:, b] = key
    return keys


def _sequence_keys(hashes: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A 64-bit name of each run of words, in their order."""
    if not len(at):
        return np.zeros(0, np.int64)
    place = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    with np.errstate(over="ignore"):
        term = words.mix(_picked(hashes, at, number) + (place.astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15))
        return words.mix(np.add.reduceat(term, np.cumsum(number) - number) ^ np.uint64(0xA5A5A5A5)).view(np.int64)


def units(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, line_words: int = LINE_WORDS,
          sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """``doc_id, text_hash, start, end`` (bytes), ``n_words, kind, key, bands``: long lines, and the sentences of lines with several.

    ``text_hash`` tells rows apart that share a ``doc_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, _BATCH):
            hashes, starts, ends, owner, new_line, new_sentence = _pieces(batch.column("text"))
            ids, own = batch.column("doc_id"), batch.column("text_hash")
            at, number, sets, sizes = _lines(hashes, new_line, line_words)
            keys = _band_keys(signatures(sets, sizes, bands * rows), bands)
            s_at, s_number = _groups(new_sentence, len(hashes))
            line_of = np.cumsum(new_line) - 1
            several = np.bincount(line_of[s_at], minlength=1)[line_of[s_at]] > 1 if len(s_at) else np.zeros(0, bool)
            use = several & (s_number >= sentence_words)
            s_at, s_number = s_at[use], s_number[use]
            both, count = np.concatenate([at, s_at]), np.concatenate([number, s_number])
            names = np.concatenate([vertex_of(sets, sizes), _sequence_keys(hashes, s_at, s_number)])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner[both])), own.take(pa.array(owner[both])), pa.array(starts[both]), pa.array(ends[both + count - 1]), pa.array(count),
                 pa.array(np.repeat(np.array([LINE, SENTENCE], np.int32), [len(at), len(s_at)])), pa.array(names),
                 lists(keys.ravel(), np.concatenate([np.full(len(at), bands), np.zeros(len(s_at), np.int64)]))],
                ["doc_id", "text_hash", "start", "end", "n_words", "kind", "key", "bands"])

    hashed = texts(docs).where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    return map_arrow(hashed, run, "doc_id long, text_hash long, start long, end long, n_words long, kind int, key long, bands binary")


def _collisions(found: DataFrame, bands: int, tasks: int | None = None) -> DataFrame:
    """Edges ``a, b`` between each paragraph and the least one of every band it shares with another."""

    def explode(batches: Iterator[pa.RecordBatch], bitmap=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = binary(batch.column("bands"), np.int64)
            owner = np.repeat(batch.column("key").to_numpy(), bands)
            if bitmap is not None:
                hit = may_match(bitmap.value, keys)
                keys, owner = keys[hit], owner[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owner)], ["band", "key"])

    lines = found.where(F.col("kind") == LINE).select("key", "bands")
    schema = "band long, key long"
    shared = written(dealt(map_arrow(lines, explode, schema).groupBy("band").agg(F.min("key").alias("a"), F.max("key").alias("z"))
                     .where("a <> z").select("band", "a"), tasks), "bands")
    bitmap = key_bitmap(shared.select("band"))
    few = map_arrow(lines, lambda batches: explode(batches, bitmap), schema)
    return few.join(shared, "band").select("a", F.col("key").alias("b")).where("a <> b").distinct()


def repeats(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, line_words: int = LINE_WORDS,
            sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """Occurrences of passages that lie in two documents or more.

    ``doc_id, text_hash, start_byte, end_byte, n_words, kind`` (line or sentence), ``class_doc_id, class_start``: the
    occurrence that stays, ``removed``: true for all others. Offsets count UTF-8 bytes of the text. Null and
    empty texts have no passages; rows with a null ``doc_id`` take no part; rows that share a ``doc_id`` are one
    document, so what repeats among them only is no repeat, but each has passages of its own, told apart by
    ``text_hash``; other columns are ignored. Clean documents have no rows.
    """
    found = written(units(docs, bands, rows, line_words, sentence_words), "units")
    tasks = tasks_for(found.count(), _TASK_UNITS)
    equal = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("key")
    clusters = connected_components(_collisions(found, bands, tasks), tasks=tasks).select("vertex", F.col("component").alias("cluster"))
    clusters = written(dealt(sized(clusters), tasks), "clusters")
    wanted = key_bitmap(clusters.select("vertex"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches_of(batches, _BATCH):
            hashes, _, _, _, new_line, _ = _pieces(batch.column("text"))
            _, _, sets, sizes = _lines(hashes, new_line, line_words)
            names = vertex_of(sets, sizes)
            own = pa.RecordBatch.from_arrays([pa.array(names), lists(sets, sizes)], ["vertex", "items"])
            yield own.filter(pa.array(may_match(bitmap, names)))

    again = map_arrow(texts(docs).where("doc_id IS NOT NULL"), sets_of, "vertex long, items binary").dropDuplicates(["vertex"])
    members = written(dealt(again.join(clusters, "vertex"), tasks), "paragraphs")
    joined = written(dealt(confirm(members, percent, tasks=tasks), tasks), "classes")
    keys = written(dealt(equal.select("key").unionByName(joined.select(F.col("vertex").alias("key"))), tasks), "keys")
    bitmap = key_bitmap(keys)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_match(bitmap.value, batch.column("key").to_numpy())))

    few = map_arrow(found.drop("bands"), keep, "doc_id long, text_hash long, start long, end long, n_words long, kind int, key long")
    classed = (few.join(joined.withColumnRenamed("vertex", "key"), "key", "left")
               .withColumn("class", F.coalesce("component", "key")).drop("component", "key"))
    classed = written(dealt(classed, tasks), "occurrences")
    first = (classed.groupBy("class").agg(F.min(F.struct("doc_id", "start", "text_hash")).alias("f"), F.max("doc_id").alias("z"))
             .where("f.doc_id <> z").select("class", F.col("f.doc_id").alias("class_doc_id"), F.col("f.start").alias("class_start"),
                                            F.col("f.text_hash").alias("class_text")))
    stays = (F.col("doc_id") == F.col("class_doc_id")) & (F.col("start") == F.col("class_start")) & (F.col("text_hash") == F.col("class_text"))
    return classed.join(first, "class").select(
        "doc_id", "text_hash", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "n_words",
        F.when(F.col("kind") == LINE, "line").otherwise("sentence").alias("kind"), "class_doc_id", "class_start",
        (~stays).alias("removed")).distinct()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the byte spans, the blanks that they leave at the ends of lines, and lines they leave empty."""
    raw, out, at = text.encode(), [], 0
    for start, end in sorted(spans):
        if start > at:
            out.append(raw[at:start])
        if end > at:
            at = end
            while at < len(raw) and raw[at] in b" \t":
                at += 1
            if out and (at == len(raw) or raw[at] == 10):
                out[-1] = out[-1].rstrip(b" \t")
    out.append(raw[at:])
    return "\n".join(line for line in b"".join(out).decode().split("\n") if line.strip())


def removed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the repeated passages, columns as they were; texts left without words go.

    A row loses the passages found in its own text, whatever other rows share its ``doc_id``; where it has a
    column ``n_chars``, that follows the text. Rows with a null ``doc_id`` and texts that lose nothing, null and empty ones
    among them, stay as they are. Further columns are carried along, whatever their names, and an empty table
    stays empty. Only documents that lose something are shuffled.
    """
    doc, own, spans = unused_names(docs, "doc", "own", "spans")
    gone = repeats(docs, **options).where("removed").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start_byte", "end_byte")).alias(spans))
    gone = written(gone.withColumnsRenamed({"doc_id": doc, "text_hash": own}), "removals")
    bitmap = key_bitmap(gone.select(doc))
    columns = docs.columns

    def split(touched: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                hit = may_match(bitmap.value, ids.fill_null(0).cast(pa.int64()).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == touched))
        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(spans).to_pylist()
            new = [t if not s or t is None else without(t, [(x["start_byte"], x["end_byte"]) for x in s])
                   for t, s in zip(batch.column("text").to_pylist(), found)]
            # A text that loses nothing stays, be it empty or null.
            use = [not s or bool(_WORD.search(t)) for t, s in zip(new, found)]
            yield batch.drop_columns([spans]).set_column(columns.index("text"), "text", pa.array(new, pa.string())).filter(pa.array(use))

    kept = map_arrow(docs, split(False), docs.schema)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    touched = map_arrow(docs, split(True), docs.schema).join(
        gone, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(own)), "left")
    changed = map_arrow(touched.select(*columns, spans), cut, docs.schema)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return kept.unionByName(changed)
