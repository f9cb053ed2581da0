"""Document quality by a byte-level convolutional network, trained and run in numpy.

Bytes are embedded; learned filters slide over chunks of fixed length that overlap and together cover the
whole document. The largest response of each filter in a chunk feeds one linear unit, and the mean over
a document's chunks gives its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickframe.llm.tables import batches_of, map_arrow, texts, training_row
from tickframe.llm.words import text_bytes

CHUNK = 512
OVERLAP = 64
WIDTH = 8
STRIDE = 2
DIMENSIONS = 8
FILTERS = 32
# Labelled documents per class that the network is fitted on, and chunks of each, spread over it.
SAMPLE = 1200
SAMPLE_CHUNKS = 6
EPOCHS = 8
THRESHOLD = 0.7
_BATCH = 2 << 20
_AT_ONCE = 32


@dataclass
class Network:
    embedding: np.ndarray  # 256 x dimensions
    filters: np.ndarray  # width * dimensions x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def chunk_starts(size: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Starts of the chunks of a text of so many bytes; the last chunk ends with the text."""
    if size <= chunk:
        return np.zeros(1, np.int64)
    starts = np.arange(0, size - chunk, chunk - overlap)
    return np.append(starts, size - chunk)


def chunks_of(data: np.ndarray, bounds: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts as rows, filled up with zeros, and the number per text."""
    starts = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = chunk_starts(b - a)
        if most and len(own) > most:
            own = own[np.linspace(0, len(own) - 1, most).astype(np.int64)]
        starts.append(own + a)
    number = np.array([len(s) for s in starts], np.int64)
    at = np.concatenate(starts)[:, None] + np.arange(CHUNK) if starts else np.zeros((0, CHUNK), np.int64)
    ends = np.repeat(bounds[1:], number)[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8), number
    return np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), number


def _windows(network: Network, chunks: np.ndarray) -> np.ndarray:
    """Embedded windows: chunk x position x (width * dimensions)."""
    embedded = network.embedding[chunks].reshape(len(chunks), -1)
    view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * DIMENSIONS, axis=1)
    return np.ascontiguousarray(view[:, ::STRIDE * DIMENSIONS])


def _pooled(network: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response per chunk and filter, and where it lies."""
    response = windows.reshape(-1, windows.shape[2]) @ network.filters
    response = response.reshape(len(windows), -1, network.filters.shape[1])
    where = response.argmax(axis=1)
    best = np.take_along_axis(response, where[:, None], axis=1)[:, 0] + network.bias
    return np.maximum(best, 0), where


def logits(network: Network, chunks: np.ndarray) -> np.ndarray:
    """One logit per chunk."""
    out = np.empty(len(chunks), np.float64)
    for a in range(0, len(chunks), _AT_ONCE):
        some = _windows(network, chunks[a:a + _AT_ONCE])
        response = some.reshape(-1, some.shape[2]) @ network.filters
        best = response.reshape(len(some), -1, network.filters.shape[1]).max(axis=1) + network.bias
        out[a:a + _AT_ONCE] = np.maximum(best, 0) @ network.weights + network.offset
    return out


def train(documents: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fits the network on (text, label) by Adam. Without both classes it answers with the only class."""
    rng = np.random.Generator(np.random.PCG64(seed))
    width = WIDTH * DIMENSIONS
    network = Network(rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32),
                      rng.normal(0, (2 / width) ** 0.5, (width, FILTERS)).astype(np.float32),
                      np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), 0.0)
    network.embedding[0] = 0
    found = {label for _, label in documents}
    if len(found) < 2:
        network.weights[:] = 0
        network.offset = 4.0 if found != {0} else -4.0
        return network
    data, bounds = text_bytes(pa.array([t for t, _ in documents], pa.large_string()))
    chunks, number = chunks_of(data, bounds, SAMPLE_CHUNKS)
    labels = np.repeat(np.array([y for _, y in documents], np.float32), number)
    # Every document counts alike, and both classes count alike.
    weight = np.repeat(1 / number, number)
    for y in (0, 1):
        weight[labels == y] *= len(weight) / 2 / weight[labels == y].sum()
    state = {name: [np.zeros_like(getattr(network, name)), np.zeros_like(getattr(network, name))]
             for name in ("embedding", "filters", "bias", "weights")}
    state["offset"] = [0.0, 0.0]
    step, size = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(chunks))
        for a in range(0, len(order), size):
            own = order[a:a + size]
            windows = _windows(network, chunks[own])
            pooled, where = _pooled(network, windows)
            z = pooled @ network.weights + network.offset
            delta = ((1 / (1 + np.exp(-z)) - labels[own]) * weight[own] / len(own)).astype(np.float32)
            back = delta[:, None] * network.weights * (pooled > 0)
            picked = np.take_along_axis(windows, where[:, :, None], axis=1)  # chunk x filter x width
            grads = {"weights": pooled.T @ delta + 1e-4 * network.weights, "offset": float(delta.sum()), "bias": back.sum(axis=0),
                     "filters": np.einsum("cf,cfw->wf", back, picked)}
            spread = back[:, :, None] * network.filters.T[None]
            at = where[:, :, None] * STRIDE + np.arange(WIDTH)
            letters = np.take_along_axis(chunks[own][:, None, :].repeat(FILTERS, axis=1), at, axis=2)
            into = np.zeros_like(network.embedding)
            np.add.at(into, letters.ravel(), spread.reshape(-1, DIMENSIONS))
            into[0] = 0
            grads["embedding"] = into
            step += 1
            for name, g in grads.items():
                m, v = state[name]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[name] = [m, v]
                change = 0.004 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
                setattr(network, name, getattr(network, name) - change)
    return network


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2,
        sample: int = SAMPLE) -> Network:
    """Trains on at most ``sample`` documents per class, those whose ids have the least hashes.

    Rows with ``crc32(doc_id) % modulus == held_out`` are never used, nor those with null id, text or label.
    """
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .where("y IN (0, 1)").where(training_row(modulus, held_out)).groupBy("doc_id").agg(F.min("y").alias("y"))
              .withColumn("h", F.xxhash64("doc_id")))
    known = texts(docs.where(F.col("text").isNotNull())).select("doc_id").where("doc_id IS NOT NULL").distinct()
    marked = marked.join(known, "doc_id", "left_semi")
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample).collect()]
    spark = docs.sparkSession
    # At most twice ``sample`` rows of two numbers.
    ids = F.broadcast(spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "doc_id long, y int"))
    rows = texts(docs).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([(r["text"], r["y"]) for r in rows])


def _scored(docs: DataFrame, network: Network, *carried: Column) -> DataFrame:
    """``doc_id``, what is ``carried``, and ``score``."""
    source = texts(docs, *carried)
    names = [c for c in source.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, _BATCH):
            data, bounds = text_bytes(batch.column("text"))
            sizes = np.diff(bounds)
            number = np.where(sizes <= CHUNK, 1, -(-(sizes - CHUNK) // (CHUNK - OVERLAP)) + 1)
            total = np.zeros(len(sizes))
            # Chunks are cut for a few documents at a time; a long one is cut by itself.
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(number) // 512)) + 1, [len(sizes)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                chunks, own = chunks_of(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                total[a:b] = np.add.reduceat(logits(network, chunks), np.cumsum(own) - own) / own
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(1 / (1 + np.exp(-np.clip(total, -50, 50))))],
                                             [*names, "score"])

    return map_arrow(source, run, StructType([*[source.schema[n] for n in names], StructField("score", DoubleType())]))


def score(docs: DataFrame, network: Network, modulus: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``, from all bytes of its text.

    A null or empty text is one chunk of zeros. A null ``doc_id`` stays null and is not held out; other
    columns are ignored; an empty table gives no rows.
    """
    return _scored(docs, network).select("doc_id", (~training_row(modulus, held_out)).alias("held_out"), "score",
                                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, columns as they were."""
    return _scored(docs, network, F.struct("*").alias("_row")).where(F.col("score") >= threshold).select("_row.*")
