"""Inventory totals and deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators import segments

_TICK = ["session_id", "tick"]


def item_totals(slots: DataFrame) -> DataFrame:
    """Count per item over all slots of a tick."""
    return (slots.where(F.col("count") > 0).groupBy(*_TICK, "item")
            .agg(F.sum("count").cast("long").alias("count")))


def slot_lists(slots: DataFrame) -> DataFrame:
    """Non-empty slots of a tick as a list; an inventory has at most 41 slots."""
    return (slots.where(F.col("count") > 0).groupBy(*_TICK)
            .agg(F.sort_array(F.collect_list(F.struct("slot", "item", "count")))
                 .alias("inventory")))


def item_deltas(totals: DataFrame, ticks: DataFrame, reset_every: int | None = None) -> DataFrame:
    """Items whose count differs from the tick before; an absent item counts 0.

    A count is written twice, as the current value of its own tick and as the previous value
    of the next one, and both meet in one aggregation. No join of snapshots, no window, and
    no row for an item that did not change hands. ``ticks`` (session_id, tick) is dense: a
    tick without items is an empty snapshot, and nothing follows a session's last tick.

    ``reset_every`` forgets the snapshot at each multiple, as the event log does per chunk.
    """
    sides = [F.struct(F.col("tick").alias("tick"), F.col("count").alias("count"),
                      F.lit(0).cast("long").alias("prev_count"))]
    follow = F.struct((F.col("tick") + 1).alias("tick"), F.lit(0).cast("long").alias("count"),
                      F.col("count").alias("prev_count"))
    if reset_every is not None:
        follow = F.when((F.col("tick") + 1) % reset_every != 0, follow)
    both = (totals.select("session_id", "item",
                          F.explode(F.array_compact(F.array(*sides, follow))).alias("s"))
            .select("session_id", "item", "s.*"))
    met = (both.groupBy("session_id", "item", "tick")
           .agg(F.sum("count").alias("count"), F.sum("prev_count").alias("prev_count"))
           .where(F.col("count") != F.col("prev_count")))
    ends = ticks.groupBy("session_id").agg(F.max("tick").alias("_end"))
    return (met.join(ends, "session_id").where(F.col("tick") <= F.col("_end"))
            .select("session_id", "tick", "item", "count", "prev_count",
                    (F.col("count") - F.col("prev_count")).alias("delta")))


def observed_deltas(totals: DataFrame, ticks: DataFrame, reset_every: int | None = None, width: int | None = None) -> DataFrame:
    """``item_deltas`` for sessions with holes: compared is the snapshot of the last tick observed.

    ``ticks`` (session_id, tick) lists the observed ticks; one without items is an empty snapshot, a missing
    one is no snapshot. A count is written for its own tick and as the previous count of the tick that follows in
    ``ticks``, which comes from a table of successors by segment. ``reset_every`` forgets the snapshot where a
    multiple lies between both.
    """
    after = segments.following(ticks.select(*_TICK).distinct(), ["session_id"], "tick", "_next", width)
    kept = F.col("_next").isNotNull()
    if reset_every is not None:
        kept = kept & (F.call_function("div", F.col("_next"), F.lit(reset_every)) == F.call_function("div", F.col("tick"), F.lit(reset_every)))
    none = F.lit(0).cast("long")
    now = F.struct(F.col("tick"), F.col("count"), none.alias("prev_count"))
    then = F.when(kept, F.struct(F.col("_next").alias("tick"), none.alias("count"), F.col("count").alias("prev_count")))
    both = (totals.join(after, _TICK).select("session_id", "item", F.explode(F.array_compact(F.array(now, then))).alias("s"))
            .select("session_id", "item", "s.*"))
    return (both.groupBy("session_id", "tick", "item")
            .agg(F.sum("count").alias("count"), F.sum("prev_count").alias("prev_count"))
            .where(F.col("count") != F.col("prev_count"))
            .select("session_id", "tick", "item", "count", "prev_count", (F.col("count") - F.col("prev_count")).alias("delta")))


def repair_deltas(deltas: DataFrame, keys: Sequence[str] = ("session_id", "item"),
                  width: int | None = None) -> DataFrame:
    """Deltas of chunked logs without the phantom gains at chunk starts (Q3).

    The true previous count is the one the item's last row left; rows that then change
    nothing go away. An item lost exactly between two chunks has left no row: use
    ``item_deltas`` on snapshots when that matters.
    """
    seen = segments.previous(deltas, keys, "tick", {"_was": F.col("count")}, width)
    true_prev = F.coalesce(F.col("_was.value"), F.lit(0))
    return (seen.withColumn("prev_count", true_prev).where(F.col("count") != F.col("prev_count"))
            .select(*[c for c in deltas.columns if c != "delta"],
                    (F.col("count") - F.col("prev_count")).alias("delta")))
