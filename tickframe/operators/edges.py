"""Changes between consecutive ticks of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.angles import wrap_degrees
from tickframe.functions.labels import name_contains
from tickframe.functions.text import boss_health_fixed, equipment_text
from tickframe.operators import segments
from tickframe.schemas import CHUNK_TICKS

_SESSION = ("session_id",)


def angle_deltas(ticks: DataFrame, keys: Sequence[str] = ("session_id", "chunk_index"),
                 order: str = "tick", width: int | None = None) -> DataFrame:
    """``yaw_delta`` (wrapped) and ``pitch_delta``, 0 on the first tick of each key.

    The writer forgets the previous angle when it opens a chunk, hence the default keys.
    Pass ``("session_id",)`` for deltas that cross chunk borders.
    """
    yaw, pitch = F.col("player_yaw"), F.col("player_pitch")
    seen = segments.previous(ticks, keys, order, {"_yaw": yaw, "_pitch": pitch}, width)
    return seen.select(
        *ticks.columns,
        F.coalesce(wrap_degrees(yaw - F.col("_yaw.value")), F.lit(0.0)).alias("yaw_delta"),
        F.coalesce(pitch - F.col("_pitch.value"), F.lit(0.0)).alias("pitch_delta"),
    )


def add_chunk(ticks: DataFrame, size: int = CHUNK_TICKS, order: str = "tick") -> DataFrame:
    """Chunk number of a tick when chunks are aligned at session tick 0."""
    return ticks.withColumn(
        "chunk_index", F.call_function("div", F.col(order), F.lit(size)).cast("int"))


def rising_edges(ticks: DataFrame, flag: Column, initial: bool,
                 keys: Sequence[str] = _SESSION, order: str = "tick",
                 width: int | None = None) -> DataFrame:
    """Rows where ``flag`` turns true; before the first row it has the ``initial`` value."""
    seen = segments.previous(ticks, keys, order, {"_was": flag}, width)
    was = F.when(F.col("_was").isNull(), F.lit(initial)).otherwise(F.col("_was.value"))
    return seen.where(flag & ~was).select(*ticks.columns)


def death_edges(ticks: DataFrame, **options) -> DataFrame:
    """Alive to dead (W3); a session starts alive."""
    return rising_edges(ticks, ~F.col("alive"), False, **options)


def sleep_onsets(ticks: DataFrame, **options) -> DataFrame:
    """Awake to asleep (W4); a session starts awake."""
    return rising_edges(ticks, F.col("sleeping"), False, **options)


def dimension_changes(ticks: DataFrame, keys: Sequence[str] = _SESSION, order: str = "tick",
                      width: int | None = None) -> DataFrame:
    """Ticks whose dimension differs from the last known one.

    The first known dimension is no change, and a missing one is skipped.
    """
    known = ticks.where(F.col("dimension").isNotNull())
    seen = segments.previous(known, keys, order, {"_was": F.col("dimension")}, width)
    return (seen.where(F.col("_was").isNotNull()
                       & (F.col("_was.value") != F.col("dimension")))
            .select(*ticks.columns))


def equipment_changes(stacks: DataFrame, stack_columns: Sequence[str] = ("item", "enchanted", "count"),
                      keys: Sequence[str] = ("session_id", "slot"), order: str = "tick",
                      width: int | None = None) -> DataFrame:
    """Slots whose whole stack differs from the one before (W6); slots start empty.

    ``item`` is null for an empty slot. ``equipment`` is the text the event log stores.
    """
    stack = F.struct(*[F.col(c) for c in stack_columns])
    empty = F.col("item").isNull()
    value = F.when(~empty, stack)
    seen = segments.previous(stacks, keys, order, {"_was": value}, width)
    changed = ~value.eqNullSafe(F.col("_was.value"))
    enchanted = ~empty & F.coalesce(F.col("enchanted"), F.lit(False))
    return seen.where(changed).select(
        *stacks.columns,
        equipment_text(F.col("slot"), F.coalesce("item", F.lit("empty")), enchanted).alias("equipment"),
    )


def boss_health_changes(bars: DataFrame, boss: str = "Ender Dragon",
                        keys: Sequence[str] = _SESSION, order: str = "tick",
                        width: int | None = None) -> DataFrame:
    """Matching boss bars whose percentage differs from the last one (W7, F7); starts at -1."""
    matching = bars.where(name_contains(F.col("bar_name"), boss))
    seen = segments.previous(matching, keys, order, {"_was": F.col("percent")}, width)
    was = F.coalesce(F.col("_was.value"), F.lit(-1.0))
    return seen.where(F.col("percent") != was).select(
        *bars.columns,
        boss_health_fixed(F.col("percent")).alias("health_fixed"),
    )


def held_slot(ticks: DataFrame, slot: str = "inventory_slot", keys: Sequence[str] = _SESSION,
              order: str = "tick", width: int | None = None) -> DataFrame:
    """Last slot request within 0..8, carried forward."""
    valid = F.when(F.col(slot).between(0, 8), F.col(slot))
    return segments.as_of(ticks, keys, order, {"selected_slot": valid}, width)


def unwrap_yaw(ticks: DataFrame, keys: Sequence[str] = _SESSION, order: str = "tick",
               width: int | None = None) -> DataFrame:
    """Continuous yaw from 16-bit hundredths of a degree.

    A step beyond half the 655.36-degree range is an overflow of the stored value and is
    taken back by one range.
    """
    raw = F.col("yaw_fp").cast("int")
    seen = segments.previous(ticks, keys, order, {"_was": raw}, width)
    step = raw - F.col("_was.value")
    turns = F.when(step > 32768, -1).when(step < -32768, 1).otherwise(0)
    counted = seen.select(*ticks.columns, F.coalesce(turns, F.lit(0)).alias("_turns"))
    summed = segments.running_total(counted, keys, order, {"_sum": F.col("_turns")}, width)
    return summed.select(
        *ticks.columns, ((raw + F.col("_sum") * 65536) / 100.0).alias("yaw_unwrapped"))
