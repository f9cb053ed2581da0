"""Agent actions: hold-last join and camera integration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions.angles import movement_axis
from tickframe.operators import segments
from tickframe.operators.row_runs import key_at, run_starts
from tickframe.operators.segments import SEGMENT
from tickframe.runtime import ship_package
from tickframe.schemas import ACTION, ACTION_DEFAULTS

PITCH_LIMIT = 90.0


def fill_action(actions: DataFrame) -> DataFrame:
    """Defaults for the fields an action message leaves out."""
    known = {f.name: f.dataType for f in ACTION}
    return actions.select(*[
        F.coalesce(F.col(c), F.lit(ACTION_DEFAULTS[c]).cast(known[c])).alias(c)
        if c in known else F.col(c) for c in actions.columns])


def hold_last(ticks: DataFrame, actions: DataFrame, columns: Sequence[str],
              keys: Sequence[str] = ("connection_id",), at: str = "at",
              lock_step: bool = False, width: int | None = None, arrival: str | None = None) -> DataFrame:
    """The action applied at each tick.

    The newest action at or before the tick, held until a newer one arrives; null before the
    first. ``lock_step`` keeps only ticks with an action since the tick before. A connection is
    a key, so closing it drops the held action. Both inputs are united and swept once in
    order; nothing is paired. Of actions at one time the last by ``arrival`` counts, a column of ``actions`` that
    numbers them; without it their times must differ.
    """
    if arrival is not None:
        last = F.max_by(F.struct(*[c for c in actions.columns if c not in (*keys, at)]), F.col(arrival)).alias("_last")
        actions = actions.groupBy(*keys, at).agg(last).select(*keys, at, "_last.*")
    action = F.struct(F.col(at).alias("action_at"), *[F.col(c) for c in columns])
    held = ticks.select(*keys, at, F.lit(1).alias("_rank"), F.struct(
        *[F.col(c) for c in ticks.columns if c not in (*keys, at)]).alias("_tick"),
        F.lit(None).cast(actions.select(action.alias("a")).schema["a"].dataType).alias("_action"))
    offered = actions.select(*keys, at, F.lit(0).alias("_rank"),
                             F.lit(None).cast(held.schema["_tick"].dataType).alias("_tick"),
                             action.alias("_action"))
    both = held.unionByName(offered).withColumn("_order", F.col(at) * 2 + F.col("_rank"))
    size = 2 * (segments.SEGMENT_TICKS if width is None else width)
    swept = segments.as_of(both, keys, "_order", {"_held": F.col("_action")}, size)
    if lock_step:
        tick_at = F.when(F.col("_rank") == 1, F.col(at))
        swept = segments.as_of(swept, keys, "_order", {"_tick_before": tick_at}, size,
                               include_current=False)
        fresh = F.col("_held.action_at") > F.coalesce("_tick_before", F.lit(-1))
        swept = swept.where((F.col("_rank") == 1) & fresh)
    return swept.where(F.col("_rank") == 1).select(
        *keys, at, "_tick.*", *[F.col(f"_held.{c}").alias(c) for c in ("action_at", *columns)])


def movement(actions: DataFrame) -> DataFrame:
    """Forward and sideways axes from the pressed keys (P25)."""
    return actions.select(
        *actions.columns,
        movement_axis(F.col("forward"), F.col("back")).alias("movement_forward"),
        movement_axis(F.col("left"), F.col("right")).alias("movement_sideways"))


def camera_yaw(actions: DataFrame, start_yaw: float = 0.0,
               keys: Sequence[str] = ("session_id",), order: str = "tick",
               width: int | None = None) -> DataFrame:
    """Yaw after each action."""
    turned = segments.running_total(actions, keys, order, {"_turned": F.col("delta_yaw")}, width)
    return turned.select(*actions.columns, (F.col("_turned") + F.lit(start_yaw)).alias("yaw"))


_CLAMP = ("_shift", "_low", "_high")


def _compose_runs(shift: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
    """Turns steps into prefix compositions, in place; ``depth`` counts a row's predecessors.

    A triple maps x to ``min(high, max(low, x + shift))``, and two of them compose to a
    third. Rows at distance 1, 2, 4, ... are composed until every prefix is complete.
    """
    reach = 1
    while reach <= depth.max(initial=0):
        at = np.flatnonzero(depth >= reach)
        before = at - reach
        composed = (shift[before] + shift[at],
                    np.clip(low[before] + shift[at], low[at], high[at]),
                    np.clip(high[before] + shift[at], low[at], high[at]))
        shift[at], low[at], high[at] = composed
        reach *= 2


def _scan_clamps(keys: Sequence[str]):
    names = list(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, carried = None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts = run_starts(batch, names)
            depth = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            triple = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in _CLAMP]
            if key_at(batch, names, 0) == previous:
                # The key goes on from the batch before: fold that prefix into its first row.
                pair = [np.array([old, part[0]]) for old, part in zip(carried, triple)]
                _compose_runs(*pair, np.array([0, 1]))
                for part, composed in zip(triple, pair):
                    part[0] = composed[1]
            _compose_runs(*triple, depth)
            previous, carried = key_at(batch, names, n - 1), [part[-1] for part in triple]
            kept = [name for name in batch.schema.names if name not in _CLAMP]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(part) for part in triple]],
                names=[*kept, *_CLAMP])

    return scan


def _prefix_clamps(steps: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replaces each row's triple by the composition of its key's triples up to that row."""
    kept = [f for f in steps.schema if f.name not in _CLAMP]
    out = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in _CLAMP]])
    return (steps.repartition(*keys).sortWithinPartitions(*keys, order)
            .mapInArrow(_scan_clamps(keys), out))


def camera_pitch(actions: DataFrame, start_pitch: float = 0.0,
                 keys: Sequence[str] = ("session_id",), order: str = "tick",
                 width: int | None = None) -> DataFrame:
    """Pitch after each action, held within +-90 at every step.

    A clamped step cannot be a running sum, but any run of clamped steps is one triple.
    Segments are scanned independently, the triples of a session's segments (at most 32,768) give
    the pitch each segment starts from, and one expression combines both.
    """
    ship_package(actions.sparkSession)
    limit = F.lit(PITCH_LIMIT)
    steps = segments.add_segment(actions, order, width).select(
        "*", F.col("delta_pitch").cast("double").alias("_shift"),
        (-limit).alias("_low"), limit.alias("_high"))
    scanned = _prefix_clamps(steps, [*keys, SEGMENT], order)
    whole = (scanned.groupBy(*keys, SEGMENT).agg(F.max_by(F.struct(*_CLAMP), order).alias("_t"))
             .select(*keys, SEGMENT, "_t.*"))

    def applied(pitch):
        return F.least("_high", F.greatest("_low", pitch + F.col("_shift")))

    start = F.lit(float(start_pitch))
    entered = _prefix_clamps(whole, keys, SEGMENT).select(*keys, SEGMENT, F.lag(
        applied(start), 1, float(start_pitch)).over(
            Window.partitionBy(*keys).orderBy(SEGMENT)).alias("_entry"))
    return (scanned.join(entered, [*keys, SEGMENT])
            .select(*actions.columns, applied(F.col("_entry")).alias("pitch")))
