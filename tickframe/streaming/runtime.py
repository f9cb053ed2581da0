"""What stateful streams need around them: a session with the right state store, a clock that nothing is late for."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.runtime import ship_package

ARRIVED = "arrived_at"
_STORE = {"spark.sql.streaming.stateStore.providerClass":
          "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stateful_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session beside ``spark`` with its settings and the state store that typed state needs.

    The caller's session keeps its own settings. A stream runs with those of the session it is read with;
    ``partitions`` is the number of its state stores, which stays as it is for the life of a checkpoint.
    """
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    for key, value in _STORE.items():
        beside.conf.set(key, value)
    if partitions is not None:
        beside.conf.set("spark.sql.shuffle.partitions", str(partitions))
    ship_package(spark)
    return beside


def by_arrival(stream: DataFrame, slack: str = "10 seconds") -> DataFrame:
    """Adds the time a row arrives with its batch as event time, for timers.

    A watermark over the rows' own time would make Spark drop what comes late. Arrival never runs
    behind, as long as the driver's clock does not go back by more than ``slack``.
    """
    return stream.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, slack)


def source_name(checkpoint: str) -> str:
    """Names what a checkpoint writes: another checkpoint counts batches anew and must not overwrite it."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
