"""A bitmap of fixed size over 64-bit keys: rows whose key cannot match are left out before a join.

The bitmap has ``BITS`` bits whatever the data, so it may be collected and broadcast. It never loses a
match; where it fills up, the join after it does more of the work.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def key_bitmap(keys: DataFrame, bits: int = BITS) -> Broadcast:
    """Of the only column of ``keys``, of type long. At most ``bits / 64`` rows reach the driver."""
    slot = F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1))
    words = (keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({keys.columns[0]} & 63 AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).where("word IS NOT NULL"))
    found = words.toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def may_match(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the bitmap's."""
    keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys
    slot = keys & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
