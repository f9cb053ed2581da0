"""Packets of a tick and packet statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.labels import packet_name

_TICK = ["session_id", "tick"]

# Packet references kept in one array cell.
PART_PACKETS = 65_536


def packets_of(packets: DataFrame, session_id: str, tick: int) -> DataFrame:
    """Packets of one tick in file order."""
    return (packets.where((F.col("session_id") == session_id) & (F.col("tick") == tick))
            .orderBy("pos"))


def packet_lists(packets: DataFrame, part_packets: int = PART_PACKETS) -> DataFrame:
    """Packet references per tick in file order, without payloads.

    A packet belongs to the ``part`` of its tick that its place behind the tick's first packet gives, in steps of
    ``part_packets``. So no list is longer than that, however many packets a tick has, and the parts do not depend
    on anything but the log. Only ticks that reach beyond their first part need their first place; they are few, mostly
    none, and then Spark removes the join with them at run time.
    """
    spans = packets.groupBy(*_TICK).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    wide = spans.where(F.col("_last") - F.col("_first") >= part_packets).drop("_last")
    part = F.coalesce(F.call_function("div", F.col("pos") - F.col("_first"), F.lit(part_packets)), F.lit(0)).cast("int")
    reference = F.struct("pos", F.col("packet_id").alias("id"), F.col("data_len").alias("len"),
                         "timestamp_ms")
    return (packets.join(wide, _TICK, "left").withColumn("part", part)
            .groupBy(*_TICK, "part")
            .agg(F.transform(F.sort_array(F.collect_list(reference)),
                             lambda r: r.dropFields("pos")).alias("packets")))


def tick_packets(ticks: DataFrame, packets: DataFrame,
                 part_packets: int = PART_PACKETS) -> DataFrame:
    """Ticks with their packet lists, an empty list where a tick has none (J1); one row per ``part``.

    Where chunks overlap, a tick number comes more than once; its packets go to the first row only (T17), by
    ``place`` as the capture reader gives it, or by ``row_in_log``. Rows with neither must have tick numbers of their own.
    """
    lists = packet_lists(packets, part_packets)
    by = next((c for c in ("place", "row_in_log") if c in ticks.columns), None)
    if by is not None:
        first = ticks.groupBy(*_TICK).agg(F.min(by).alias(by))
        joined = ticks.join(lists.join(first, _TICK), [*_TICK, by], "left")
    else:
        joined = ticks.join(lists, _TICK, "left")
    empty = F.array().cast(lists.schema["packets"].dataType)
    return joined.select(*ticks.columns, F.coalesce("part", F.lit(0)).alias("part"),
                         F.coalesce("packets", empty).alias("packets"))


def type_counts(packets: DataFrame) -> DataFrame:
    """Packets per type, most frequent first."""
    return (packets.groupBy("packet_id").agg(F.count("*").alias("packets"))
            .select("packet_id", packet_name(F.col("packet_id")).alias("packet_name"), "packets")
            .orderBy(F.col("packets").desc(), "packet_id"))


def bytes_read(packets: DataFrame, header_bytes: int, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Bytes the whole packets of a log take up (A9); compare with the file length."""
    return packets.groupBy(*keys).agg(
        F.count("*").alias("packets"),
        F.sum(F.col("data_len") + header_bytes).cast("long").alias("bytes_read"))
