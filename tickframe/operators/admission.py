"""Session admission (F1, F2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_starts(verdicts: DataFrame) -> DataFrame:
    """First tick with a final verdict per session and that verdict; transient denials retry."""
    final = F.when(F.col("verdict") != "DENY_TRANSIENT", F.col("tick"))
    return verdicts.groupBy("session_id").agg(
        F.min(final).alias("start_tick"),
        F.min_by(F.col("verdict"), final).alias("verdict"))


def admitted_ticks(verdicts: DataFrame) -> DataFrame:
    """Ticks from the first ALLOW on, of sessions not denied before it."""
    starts = session_starts(verdicts).where(F.col("verdict") == "ALLOW").drop("verdict")
    return (verdicts.join(starts, "session_id")
            .where(F.col("tick") >= F.col("start_tick")).select(*verdicts.columns))
