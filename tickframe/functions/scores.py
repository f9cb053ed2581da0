"""Scores and identifiers of a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pars and weights of the scores (fixed values).
ROD_PAR, ROD_PENALTY = 7, 5
PEARL_PAR, PEARL_PENALTY = 12, 2
DEATH_PENALTY = 10
NETHER_PAR_TICKS, NETHER_TICKS_PER_POINT = 2880, 144


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def efficiency_score(rods_used: Column, pearls_used: Column, deaths: Column) -> Column:
    over_rods = F.greatest(rods_used - ROD_PAR, F.lit(0))
    over_pearls = F.greatest(pearls_used - PEARL_PAR, F.lit(0))
    raw = 100 - over_rods * ROD_PENALTY - over_pearls * PEARL_PENALTY - deaths * DEATH_PENALTY
    return clamp(raw, 0, 100).cast("int")


def nether_score(nether_ticks: Column) -> Column:
    """Integer division truncates toward zero; -1 when the nether was never ticked."""
    points = F.call_function("div", nether_ticks - NETHER_PAR_TICKS, F.lit(NETHER_TICKS_PER_POINT))
    return F.when(nether_ticks > 0, clamp(100 - points, 0, 100)).otherwise(-1).cast("int")


def outcome(kill_tick: Column, deaths: Column) -> Column:
    return F.when(kill_tick >= 0, "win").when(deaths > 0, "death").otherwise("quit")


def run_id(session_id: Column, player_id: Column) -> Column:
    """A digest laid out as a UUID, so a rerun writes the same id."""
    digest = F.sha2(F.concat_ws("|", session_id, player_id), 256)
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in
                              ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
