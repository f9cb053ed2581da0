"""Exact position of every row within its key, whatever the skew of the keys.

The segments of ``segments.py`` need an integer order such as a tick. Raw event rows
only have a timestamp and an id, and one key, even one instant, may hold a large
share of them. Range partitioning on (key, order..., unique id) splits such a key by
its order values, so every task sorts about the same number of rows. Numbering inside
a partition is then a running count, and only the key a partition begins with needs
the count of the partitions before: at most one row per partition.

The numbered rows are written once to the folder in ``spark.checkpoint.dir``: range
bounds are sampled, so the rows and the offsets have to come from the same run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.operators.row_runs import key_at, run_starts
from tickframe.runtime import ship_package
from tickframe.sinks.shared import write_shared

_PART, _LOCAL = "_part", "_local"


def _count_within(keys: Sequence[str]):
    names = list(keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts = run_starts(batch, names)
            local = np.arange(n, dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, n)))
            if key_at(batch, names, 0) == previous:
                local[:starts[1] if len(starts) > 1 else n] += count
            previous, count = key_at(batch, names, n - 1), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local)], names=[*batch.schema.names, _LOCAL])

    return number


def number_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` plus their 0-based position per key in ``order``, which must be unique per key."""
    ship_package(rows.sparkSession)
    by = [*keys, *order]
    placed = (rows.repartitionByRange(*by).sortWithinPartitions(*by)
              .withColumn(_PART, F.spark_partition_id()))
    schema = T.StructType([*placed.schema.fields, T.StructField(_LOCAL, T.LongType())])
    numbered = write_shared(placed.mapInArrow(_count_within(keys), schema), "numbered")

    sizes = numbered.groupBy(*keys, _PART).agg((F.max(_LOCAL) + 1).alias("_size"))
    # Most keys lie in one partition and carry nothing on.
    spread = (sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1").drop("_parts"))
    sizes = sizes.join(spread, list(keys), "left_semi")
    before = (Window.partitionBy(*keys).orderBy(_PART)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = (sizes.withColumn("_before", F.sum("_size").over(before))
               .where(F.col("_before").isNotNull()).drop("_size"))
    carried = write_shared(carried, "numbered_carry")
    # At most one row per range partition: only its first key can have begun earlier.
    return (numbered.join(F.broadcast(carried), [*keys, _PART], "left")
            .select(*rows.columns,
                    (F.col(_LOCAL) + F.coalesce("_before", F.lit(0))).alias(name)))
