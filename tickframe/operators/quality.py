"""Ledger, upload and accuracy checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.angles import distance
from tickframe.operators import segments
from tickframe.schemas import POSITION_ALERT_BLOCKS, UPLOAD_FILES

ENTITY_DEATH_STATUS = 3


def entity_kills(statuses: DataFrame, entities: DataFrame) -> DataFrame:
    """Death statuses with the type of the entity; unknown entities drop out.

    No broadcast hint: Spark broadcasts the lookup when its measured size allows, and splits
    skewed entity ids when it does not.
    """
    deaths = statuses.where(F.col("status") == ENTITY_DEATH_STATUS)
    return deaths.join(entities.select("session_id", "entity_id", "entity_type")
                       if "session_id" in entities.columns
                       else entities.select("entity_id", "entity_type"),
                       ["session_id", "entity_id"] if "session_id" in entities.columns
                       else ["entity_id"])


def position_errors(predicted: DataFrame, recorded: DataFrame) -> DataFrame:
    """Distance between predicted and recorded position on each tick both have."""
    p, r = predicted.alias("p"), recorded.alias("r")
    error = distance(*[F.col(f"{side}.{axis}").cast("double") for side in "pr" for axis in "xyz"])
    return (p.join(r, ["session_id", "tick"])
            .select("session_id", "tick", error.alias("pos_error")))


def error_report(errors: DataFrame, limit: float = POSITION_ALERT_BLOCKS) -> DataFrame:
    """Average error per session and whether it is above the limit."""
    return errors.groupBy("session_id").agg(
        F.count("*").alias("ticks"), F.avg("pos_error").alias("avg_error"),
        (F.avg("pos_error") > limit).alias("alert"))


def missing_files(chunks: DataFrame, present: DataFrame) -> DataFrame:
    """Files an upload still needs: expected names per chunk minus those present."""
    expected = chunks.select("session_id", "chunk_index", F.explode(
        F.array(*[F.lit(name) for name in UPLOAD_FILES])).alias("file"))
    return expected.join(present, ["session_id", "chunk_index", "file"], "left_anti")


def ready_chunks(chunks: DataFrame, present: DataFrame) -> DataFrame:
    """Chunks whose outputs are all there (F11), counted in one aggregation."""
    needed = present.where(F.col("file").isin(*UPLOAD_FILES))
    complete = (needed.groupBy("session_id", "chunk_index")
                .agg(*[F.max(F.col("file") == name).alias(f"_{i}")
                       for i, name in enumerate(UPLOAD_FILES)])
                .where(" AND ".join(f"_{i}" for i in range(len(UPLOAD_FILES)))))
    return chunks.join(complete.select("session_id", "chunk_index"),
                       ["session_id", "chunk_index"], "left_semi")


def not_uploaded(ledger: DataFrame) -> DataFrame:
    """Chunks whose upload is not confirmed (Q4)."""
    return ledger.where(~F.col("uploaded"))


def normalise_ends(chunks: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """Inclusive end ticks: the final chunk of an ended session stores its end one past the last.

    ``ended`` lists the sessions that are over; without it all are.
    """
    final = chunks.groupBy("session_id").agg(F.max("chunk_index").alias("_final"))
    if ended is not None:
        final = final.join(ended, "session_id", "left_semi")
    end = F.col("end_tick") - F.when(F.col("chunk_index") == F.col("_final"), 1).otherwise(0)
    return (chunks.join(final, "session_id", "left")
            .withColumn("end_tick", end.cast(chunks.schema["end_tick"].dataType))
            .select(*chunks.columns))


def ledger_gaps(chunks: DataFrame, width: int | None = None) -> DataFrame:
    """Chunks that do not start right after the one before (Q1); the first starts at 0.

    End ticks are inclusive. ``gap`` is positive for missing ticks, negative for an overlap.
    """
    seen = segments.previous(chunks, ["session_id"], "chunk_index",
                             {"_was": F.col("end_tick")}, width)
    expected = F.coalesce(F.col("_was.value") + 1, F.lit(0))
    return (seen.withColumn("expected_start", expected.cast("long"))
            .withColumn("gap", F.col("start_tick") - F.col("expected_start"))
            .where(F.col("gap") != 0)
            .select("session_id", "chunk_index", "start_tick", "expected_start", "gap"))


def tick_mismatches(capture: DataFrame) -> DataFrame:
    """Records whose stored tick is not their position (Q2)."""
    return capture.where(F.col("tick") != F.col("recorded_tick"))


def with_manifest(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows with the fields of their session's manifest, nulls where there is none."""
    return rows.join(manifests, "session_id", "left")
