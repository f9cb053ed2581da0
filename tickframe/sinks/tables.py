"""Table, JSON and ledger writers (K1-K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions import angles, bits, labels
from tickframe.operators import chunks
from tickframe.schemas import CAPTURE_CHUNK_TICKS
from tickframe.sinks.session_files import write_by_tasks

MAX_ROWS_PER_FILE = 5_000_000
# A folder per session means a file per session: tasks put their own files in place, or the driver renames all of them, one
# by one. A job that fails may leave some; ``_SUCCESS`` tells a whole table either way, and a task that runs again overwrites its own.
_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def write_by_session(df: DataFrame, path: str, mode: str = "overwrite", order: str = "tick") -> None:
    """Parquet in ``session_id=`` folders, rows sorted by tick (K1, K8).

    Rows are ranged over (session, tick): a task writes few folders, and a session too large
    for one task is written by several. Sorted ticks give each row group a narrow range. Spark's writer serves where
    the tasks have no file system for the path.
    """
    placed = df.repartitionByRange("session_id", order).sortWithinPartitions("session_id", order)
    if write_by_tasks(placed, "session_id", path, mode, MAX_ROWS_PER_FILE, _COMMIT):
        return
    (placed.write.mode(mode).option("maxRecordsPerFile", MAX_ROWS_PER_FILE).options(**_COMMIT)
     .partitionBy("session_id").parquet(path))


def label_events(events: DataFrame, mode: str = "full") -> DataFrame:
    return events.withColumn("event_type", labels.event_label(F.col("event_type"), mode))


def write_events(events: DataFrame, path: str, mode: str = "overwrite", labels_mode: str = "full") -> None:
    """Events with decoded type in ``session_id=`` folders (K2)."""
    write_by_session(label_events(events, labels_mode), path, mode)


def export_rows(capture: DataFrame) -> DataFrame:
    """Nested export form of capture ticks that already carry ``packets``.

    A tick whose packets fill several lists has a line for each; all but the first have their ``part``.
    """
    part = F.col("part") if "part" in capture.columns else F.lit(0)
    return capture.select(
        "session_id", "tick",
        bits.unpack_flags(F.col("flags")).alias("flags"), "hotbar",
        bits.unpack_mouse(F.col("mouse_btn")).alias("mouse_buttons"),
        angles.decode_fixed(F.col("yaw_fp")).alias("yaw"),
        angles.decode_fixed(F.col("pitch_fp")).alias("pitch"),
        angles.vector(F.col("x"), F.col("y"), F.col("z")).alias("pos"),
        "health", "food", "screen_type", "xp_level",
        angles.vector(F.col("vel_x"), F.col("vel_y"), F.col("vel_z")).alias("velocity"),
        angles.vector(F.col("cursor_x"), F.col("cursor_y")).alias("cursor"),
        F.when(part > 0, part).alias("part"), "packets",
    )


def write_export(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines per session in tick order; a null packet time is left out, and the part of a first line."""
    (rows.repartitionByRange("session_id", "tick").sortWithinPartitions("session_id", "tick", F.coalesce("part", F.lit(0)))
     .write.mode(mode).option("ignoreNullFields", "true").options(**_COMMIT).partitionBy("session_id").json(path))


def write_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per run (K4)."""
    summaries.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_status(rows: DataFrame, path: str) -> None:
    """Appends status rows with their ``updated_at`` (K5, K6); nothing is rewritten."""
    rows.write.mode("append").parquet(path)


def current_chunks(status: DataFrame) -> DataFrame:
    """Newest state per chunk; an upload once confirmed stays confirmed."""
    newest = F.max_by(F.struct("start_tick", "end_tick"), F.col("updated_at"))
    return (status.groupBy("session_id", "chunk_index")
            .agg(newest.alias("_s"), F.max("uploaded").alias("uploaded"))
            .select("session_id", "chunk_index", "_s.*", "uploaded"))


def current_sessions(status: DataFrame) -> DataFrame:
    """Newest status per session (K6)."""
    return status.groupBy("session_id").agg(
        F.max_by("status", "updated_at").alias("status"),
        F.max("updated_at").alias("updated_at"))


def write_index(index: DataFrame, path: str) -> None:
    """A chunk index in the order of sessions and start ticks (O2): files hold ranges that follow one another."""
    (index.repartitionByRange("session_id", "start_tick").sortWithinPartitions("session_id", "start_tick")
     .write.mode("overwrite").parquet(path))


def write_chunked(ticks: DataFrame, path: str, size: int = CAPTURE_CHUNK_TICKS) -> DataFrame:
    """Rewrites ticks in fixed chunks and returns the index of what was written (K7, O2).

    Files hold ranges of (session, chunk, tick), sorted, so that a filter on session and tick reads a single row
    group: the others' least and greatest values rule them out (F3).
    """
    placed = chunks.positional_chunks(ticks, size)
    (placed.repartitionByRange("session_id", "chunk_no", "tick")
     .sortWithinPartitions("session_id", "chunk_no", "tick")
     .write.mode("overwrite").option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(path))
    written = ticks.sparkSession.read.schema(placed.schema).parquet(path)
    return chunks.index_of(written, "chunk_no")
