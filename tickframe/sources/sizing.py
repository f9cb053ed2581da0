"""Shuffle width from the size of the input."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

TASK_BYTES = 128 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_ours: dict[str, str] = {}


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below ``path``, from the file system's summary; no file is opened."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(jvm_path).getLength()


def partitions_for(size: int, configured: int) -> int:
    return max(configured, math.ceil(size / TASK_BYTES))


def size_shuffles(spark: SparkSession, path: str) -> None:
    """Lets shuffles start with enough partitions for the input.

    The fixed default of ``spark.sql.shuffle.partitions`` would give each task of a large job
    far more than fits in memory. Adaptive execution merges partitions that turn out
    small but cannot split an undersized number, so the starting number follows the input.
    A number somebody has set stays; one of ours grows with the largest input read.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = partitions_for(input_bytes(spark, path), configured)
    current = spark.conf.get(_INITIAL, None)
    if current is not None and current != _ours.get(spark.sparkContext.applicationId):
        return
    if wanted > configured and (current is None or int(current) < wanted):
        spark.conf.set(_INITIAL, str(wanted))
        _ours[spark.sparkContext.applicationId] = str(wanted)
