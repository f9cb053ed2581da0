"""Angles, vectors and time-of-day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_fixed(angle: Column) -> Column:
    """Hundredths of a degree to degrees."""
    return (angle / F.lit(100)).cast("float")


def wrap_degrees(delta: Column) -> Column:
    """Wrap into [-180, 180]; both ends stay as they are."""
    turn = F.lit(360.0)
    return (F.when(delta > 180, delta - turn * F.ceil((delta - 180) / turn))
            .when(delta < -180, delta + turn * F.ceil((-180 - delta) / turn))
            .otherwise(delta))


def vector(*parts: Column) -> Column:
    return F.array(*parts)


def time_of_day(world_time: Column) -> Column:
    """Remainder of a day of 24,000 ticks; keeps the sign of the input."""
    return (world_time % F.lit(24000)).cast("int")


def movement_axis(plus: Column, minus: Column) -> Column:
    """+1, 0 or -1 from a pair of opposing keys."""
    return plus.cast("int").cast("float") - minus.cast("int").cast("float")


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2) + F.pow(az - bz, 2))
