"""Connected components of a distributed edge table: shares of it are contracted, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.tables import dealt, map_arrow, tasks_for, written

SHARE = 1 << 20  # edges that one task contracts at a time


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges but the least of its component, with that least one."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(names))
    while True:
        x, y = label[x], label[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _contracted(edges: DataFrame, share: int) -> DataFrame:
    """The edges of each task as stars around the least vertices; a task that has more than ``share`` does so piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()])
            if len(a) > share:
                a, b = stars(a, b)
                if 2 * len(a) > share:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.zeros(0, np.int64)
        a, b = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(edges, run, "a long, b long")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, share: int = SHARE, tasks: int | None = None) -> DataFrame:
    """``vertex, component`` (the least vertex) for every vertex of ``edges`` (``a``, ``b``).

    Loops and nulls are left out. The edges are dealt to one task for each ``share`` of them, which contracts its own. If there
    are several shares, rounds of stars go on from there until nothing moves. The number of rounds grows with the logarithm of
    the longest path; every round is written to the shared folder, and no round collects edges.
    """
    now = written(dealt(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), tasks), "edges")
    shares = tasks_for(now.count(), share)
    now = written(_contracted(now.coalesce(shares), share), "edges")
    if shares == 1:
        now = now.coalesce(1)
    else:
        before = None
        while (state := _digest(now)) != before:
            before = state
            now = written(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
