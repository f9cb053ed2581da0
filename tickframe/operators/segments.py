"""Ordered per-key operators that do not need one task per key.

A plain ``Window.partitionBy(session)`` sorts a whole session in one task, so one
very long session holds up the job. Here the rows of a key are cut into segments
of consecutive order values. The window runs per (key, segment), and what a
segment has to know about the rows before it - the last value, a running total, a
running minimum - comes from a table with one row per segment, over which a second
window runs. The result equals that of the plain window.

A tick is a 32-bit number, so a session has at most 2**31 / 65,536 = 32,768
segments of the default width, which bounds the second window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_TICKS = 65_536
SEGMENT = "_segment"


def add_segment(rows: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """Segment number of each row; ``width`` is in units of the ``order`` column.

    Rows that already have one keep it. Operators chained on the same segments then share one
    shuffle, because Spark sees the same clustering key.
    """
    if SEGMENT in rows.columns:
        return rows
    size = SEGMENT_TICKS if width is None else width
    return rows.withColumn(SEGMENT, F.call_function("div", F.col(order), F.lit(size)))


def segment_window(keys: Sequence[str], order: str | Sequence[str]):
    columns = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys, SEGMENT).orderBy(*columns)


def _earlier_segments(keys: Sequence[str]):
    return (Window.partitionBy(*keys).orderBy(SEGMENT)
            .rowsBetween(Window.unboundedPreceding, -1))


def entry_states(rows: DataFrame, keys: Sequence[str], order: str, *,
                 last: Mapping[str, Column] | None = None,
                 total: Mapping[str, Column] | None = None,
                 lowest: Mapping[str, Column] | None = None,
                 highest: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (key, segment): the state left by all earlier segments.

    ``last`` carries the newest non-null value, ``total`` a sum (0 at the start),
    ``lowest`` and ``highest`` an extreme (null at the start).
    """
    last, total = last or {}, total or {}
    lowest, highest = lowest or {}, highest or {}
    at = F.col(order)
    parts = rows.groupBy(*keys, SEGMENT).agg(
        *[F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in last.items()],
        *[F.sum(v).alias(n) for n, v in total.items()],
        *[F.min(v).alias(n) for n, v in lowest.items()],
        *[F.max(v).alias(n) for n, v in highest.items()],
    )
    before = _earlier_segments(keys)
    return parts.select(
        *keys, SEGMENT,
        *[F.last(n, ignorenulls=True).over(before).alias(n) for n in last],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in total],
        *[F.min(n).over(before).alias(n) for n in lowest],
        *[F.max(n).over(before).alias(n) for n in highest],
    )


def with_entry(rows: DataFrame, keys: Sequence[str], order: str, **states) -> DataFrame:
    """``rows`` plus the entry state of their segment.

    The right side has one row per segment. Spark measures it at run time and
    broadcasts it only when it is below ``autoBroadcastJoinThreshold``.
    """
    return rows.join(entry_states(rows, keys, order, **states), [*keys, SEGMENT], "left")


def _border(rows: DataFrame, keys: Sequence[str], order: str):
    """``_head`` and ``_tail``: whether a row is the first or the last of its segment."""
    w = segment_window(keys, order)
    return rows.withColumns({"_head": F.lag(SEGMENT).over(w).isNull(), "_tail": F.lead(SEGMENT).over(w).isNull()})


def previous(rows: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column],
             width: int | None = None) -> DataFrame:
    """Adds, per name, the value of the row before as a struct ``{value}``; null on the first row.

    The struct tells "no row before" from "the row before held null". Only the first row of a segment
    looks beyond it: the first and last rows of all segments, two of each at most, meet in a second
    window. Both windows read the same exchange, so the rows are scanned and shuffled once.
    """
    w = segment_window(keys, order)
    cut = add_segment(rows, order, width)
    own = cut.withColumns({f"_own_{n}": v for n, v in values.items()})
    seen = _border(own, keys, order).withColumns(
        {n: F.struct(F.lag(f"_own_{n}").over(w).alias("value")) for n in values})
    inside = seen.where("NOT _head").select(*rows.columns, *values)
    across = Window.partitionBy(*keys).orderBy(order)
    entered = F.lag(SEGMENT).over(across).isNotNull()
    heads = seen.where("_head OR _tail").withColumns(
        {n: F.when(entered, F.struct(F.lag(f"_own_{n}").over(across).alias("value"))) for n in values}).where("_head")
    return inside.unionByName(heads.select(*rows.columns, *values))


def following(rows: DataFrame, keys: Sequence[str], order: str, name: str, width: int | None = None) -> DataFrame:
    """Adds the ``order`` value of the next row of the key, null on the last; like :func:`previous`."""
    cut = add_segment(rows, order, width)
    seen = _border(cut, keys, order).withColumn(name, F.lead(order).over(segment_window(keys, order)))
    inside = seen.where("NOT _tail").select(*rows.columns, name)
    across = Window.partitionBy(*keys).orderBy(order)
    tails = seen.where("_head OR _tail").withColumn(name, F.lead(order).over(across)).where("_tail")
    return inside.unionByName(tails.select(*rows.columns, name))


def last_known_before(rows: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column],
                      width: int | None = None) -> DataFrame:
    """Adds the newest non-null value strictly before each row, and keeps the segment column.

    What a segment begins with comes from the last rows of earlier segments. They are found behind the
    same exchange, and the result is still partitioned by (keys, segment): windows that follow on the same
    segments add no shuffle. Select the columns wanted before calling; all of them are shuffled. Rows with a null
    key belong to nothing and are left out.
    """
    w = segment_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    cut = add_segment(rows, order, width)
    for key in keys:  # as the join below would ask of one side only
        cut = cut.where(F.col(key).isNotNull())
    # A condition that always holds, over all columns: both readers of the exchange then ask for the same ones, and
    # Spark reuses it.
    whole = F.xxhash64(*cut.columns) >= F.lit(-(1 << 63)).cast("long")
    carried = cut.withColumns({f"_before_{n}": F.last(v, ignorenulls=True).over(w) for n, v in values.items()}).where(whole)
    tails = _border(carried, keys, order).where("_tail").select(
        *keys, SEGMENT, *[F.coalesce(v, F.col(f"_before_{n}")).alias(f"_in_{n}") for n, v in values.items()])
    earlier = _earlier_segments(keys)
    entry = tails.select(*keys, SEGMENT, *[F.last(f"_in_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in values])
    return carried.join(entry, [*keys, SEGMENT], "left").select(
        *cut.columns, *[F.coalesce(f"_before_{n}", f"_in_{n}").alias(n) for n in values])


def as_of(rows: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column],
          width: int | None = None, include_current: bool = True) -> DataFrame:
    """Adds the newest non-null value up to each row, or strictly before it."""
    cut = add_segment(rows, order, width)
    w = segment_window(keys, order).rowsBetween(Window.unboundedPreceding,
                                                0 if include_current else -1)
    joined = with_entry(cut, keys, order, last={f"_in_{n}": v for n, v in values.items()})
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.last(v, ignorenulls=True).over(w), F.col(f"_in_{n}")).alias(n)
          for n, v in values.items()],
    )


def running_total(rows: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column],
                  width: int | None = None) -> DataFrame:
    """Adds the sum of each value from the first row of the key to the current one."""
    cut = add_segment(rows, order, width)
    w = segment_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    joined = with_entry(cut, keys, order, total={f"_in_{n}": v for n, v in values.items()})
    return joined.select(
        *rows.columns,
        *[(F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"_in_{n}")).alias(n)
          for n, v in values.items()],
    )


def position(rows: DataFrame, keys: Sequence[str], order: str, name: str,
             width: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row within its key."""
    cut = add_segment(rows, order, width)
    joined = with_entry(cut, keys, order, total={"_in_rows": F.lit(1)})
    w = segment_window(keys, order)
    return joined.select(*rows.columns,
                         (F.row_number().over(w) - 1 + F.col("_in_rows")).alias(name))
