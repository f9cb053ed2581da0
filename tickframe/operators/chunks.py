"""Chunk layout: rolling, indexes, ledgers, lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import segments
from tickframe.schemas import CAPTURE_CHUNK_TICKS

_SESSION = ("session_id",)


def positional_chunks(ticks: DataFrame, size: int = CAPTURE_CHUNK_TICKS,
                      keys: Sequence[str] = _SESSION, order: str = "tick",
                      width: int | None = None) -> DataFrame:
    """Chunk number when a chunk closes after ``size`` rows, counted from the first one."""
    placed = segments.position(ticks, keys, order, "_row", width)
    return placed.select(*ticks.columns,
                         F.call_function("div", F.col("_row"), F.lit(size)).alias("chunk_no"))


def index_of(ticks: DataFrame, chunk: str, keys: Sequence[str] = _SESSION) -> DataFrame:
    """First tick, last tick and number of ticks of each chunk."""
    return ticks.groupBy(*keys, chunk).agg(
        F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"),
        F.count("*").alias("tick_count"))


def index_from_headers(headers: DataFrame) -> DataFrame:
    """Chunk index of a capture directory (S6): the writer's ``end = start + count - 1``."""
    return headers.select(
        "session_id", "path", "start_tick",
        (F.col("start_tick") + F.col("tick_count") - 1).alias("end_tick"),
        F.lit(0).cast("long").alias("file_offset"), F.col("byte_len"), F.col("crc"),
    ).sortWithinPartitions("session_id", "start_tick")


def disjoint_chunks(index: DataFrame, keys: Sequence[str] = _SESSION, width: int | None = None) -> DataFrame:
    """Ranges without overlap, each with the chunk that wins it: ``first_tick, end_tick, path, start_tick``.

    The lowest start wins, then the path. In that order a chunk wins the ticks behind all chunks before it,
    so one running maximum of their ends cuts the ranges, whatever their number and however they overlap.
    """
    unique = index.groupBy(*keys, "start_tick", "end_tick").agg(F.min("path").alias("path"))
    cut = segments.add_segment(unique, "start_tick", width)
    w = (Window.partitionBy(*keys, segments.SEGMENT).orderBy("start_tick", "path", "end_tick")
         .rowsBetween(Window.unboundedPreceding, -1))
    reached = (segments.with_entry(cut.withColumn("_here", F.max("end_tick").over(w)), keys, "start_tick",
                                   highest={"_earlier": F.col("end_tick")})
               .withColumn("_reached", F.greatest("_here", "_earlier")))
    first = F.greatest("start_tick", F.col("_reached") + 1)
    return (reached.withColumn("first_tick", first).where(F.col("first_tick") <= F.col("end_tick"))
            .select(*keys, "first_tick", "end_tick", "path", "start_tick"))


def lookup_chunk(points: DataFrame, index: DataFrame, width: int | None = None,
                 keys: Sequence[str] = _SESSION) -> DataFrame:
    """The chunk each tick lies in (J2); the lowest start, then path, when chunks overlap.

    An as-of join with the disjoint ranges, by segment: a tick takes the newest range that has begun and
    keeps it if the range has not ended. No pair is formed and no list gathered. Ticks in no chunk go away.
    """
    chunk = "struct<path:string,start_tick:bigint,end_tick:bigint>"
    begins = disjoint_chunks(index, keys, width).select(
        *keys, (F.col("first_tick") * 2).alias("_at"), F.struct("path", "start_tick", "end_tick").cast(chunk).alias("_chunk"))
    own = [c for c in points.columns if c not in keys]
    both = points.select(*keys, (F.col("tick").cast("long") * 2 + 1).alias("_at"), F.lit(None).cast(chunk).alias("_chunk"),
                         F.struct(*own).alias("_row")).unionByName(begins, allowMissingColumns=True)
    size = 2 * (segments.SEGMENT_TICKS if width is None else width)
    found = segments.as_of(both, keys, "_at", {"_hit": F.col("_chunk")}, size)
    hit = F.col("_hit.end_tick") >= F.col("_row.tick")
    return found.where(F.col("_row").isNotNull() & hit).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in points.columns],
        F.col("_hit.path").alias("path"), F.col("_hit.start_tick").alias("start_tick"),
        (F.col("_row.tick") - F.col("_hit.start_tick")).alias("offset_in_chunk"))


def tick_lookup(ticks: DataFrame, session_id: str, tick: int) -> DataFrame:
    """One tick of one session (F3): partition pruning plus a pushed filter."""
    return ticks.where((F.col("session_id") == session_id) & (F.col("tick") == tick))


def ticks_at(ticks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of many (session_id, tick) requests at once."""
    return ticks.join(wanted.select("session_id", "tick"), ["session_id", "tick"], "left_semi")


def max_tick(index: DataFrame) -> DataFrame:
    """Highest tick of an index, -1 when it is empty (A10)."""
    return index.agg(F.coalesce(F.max("end_tick").cast("long"), F.lit(-1).cast("long"))
                     .alias("max_tick"))


def chunk_counts(index: DataFrame) -> DataFrame:
    """Chunks and ticks per session."""
    return index.groupBy("session_id").agg(
        F.count("*").alias("chunks"), F.sum("tick_count").cast("long").alias("ticks"))


def session_ledger(chunks: DataFrame) -> DataFrame:
    """Ledger document per session.

    The list has one small entry per chunk. Ticks are 32-bit, so a session has at most
    2**31 / 6000 = 357,914 of them.
    """
    entry = F.struct(F.col("chunk_index").alias("index"), "start_tick", "end_tick", "uploaded")
    return chunks.groupBy("session_id").agg(
        F.min("start_time_ms").alias("started_at_ms"),
        F.max("end_time_ms").alias("ended_at_ms"),
        F.count("*").cast("int").alias("total_chunks"),
        F.sort_array(F.collect_list(entry)).alias("chunks"))


def explode_ledger(ledgers: DataFrame) -> DataFrame:
    """One row per chunk of a session ledger."""
    return (ledgers.select("session_id", F.explode("chunks").alias("c"))
            .select("session_id", F.col("c.index").alias("chunk_index"),
                    "c.start_tick", "c.end_tick", "c.uploaded"))


def absolute_time(ticks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Wall-clock time of a tick (P20, J9): its clock restarts with every chunk.

    Every tick stays; without a manifest its time is null (see ``without_manifest``).
    """
    starts = manifests.select("session_id", "chunk_index", "start_time_ms")
    at = F.col("start_time_ms") + F.col("timestamp_ms")
    return (ticks.join(starts, ["session_id", "chunk_index"], "left")
            .select(*ticks.columns, at.alias("at_ms"), F.timestamp_millis(at).alias("at")))


def without_manifest(ticks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Ticks whose chunk has no manifest."""
    return ticks.join(manifests.select("session_id", "chunk_index"), ["session_id", "chunk_index"], "left_anti")


def latest(sessions: DataFrame, by: str = "modified_at", n: int = 1) -> DataFrame:
    """Newest sessions first (O1); the id settles ties."""
    return sessions.orderBy(F.col(by).desc(), F.col("session_id")).limit(n)


def preview(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of every key.

    The rank filter is pushed below the shuffle, so a task sends at most ``n`` rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return (rows.withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= n).drop("_rank"))


def with_chunks_only(sessions: DataFrame, index: DataFrame) -> DataFrame:
    """Sessions that have at least one chunk."""
    return sessions.join(index.select("session_id"), "session_id", "left_semi")
