"""Packets of ticks: orders are ticks, their line items are packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import packets
from tickframe.plans import workload as W
from tickframe.plans.registry import query
from tickframe.schemas import PACKET_HEADER_BYTES_V2, PACKET_NAMES

SESSIONS = 64

_P = f"""WITH ticks AS (SELECT CAST(o_orderkey % {SESSIONS} AS VARCHAR) AS session_id, o_orderkey AS tick FROM orders),
packets AS (SELECT CAST(l_orderkey % {SESSIONS} AS VARCHAR) AS session_id, l_orderkey AS tick,
  l_orderkey * 8 + l_linenumber AS pos, l_suppkey % 10 AS packet_id, CAST(l_quantity AS BIGINT) AS data_len,
  epoch_us(l_shipdate) // 1000 AS timestamp_ms FROM lineitem)"""


def packet_rows(spark, sf_dir):
    order = F.col("l_orderkey")
    return W.table(spark, sf_dir, "lineitem").select(
        (order % SESSIONS).cast("string").alias("session_id"), order.alias("tick"),
        (order * 8 + F.col("l_linenumber")).alias("pos"),
        (F.col("l_suppkey") % 10).cast("int").alias("packet_id"),
        F.col("l_quantity").cast("long").alias("data_len"),
        W.epoch_ms(F.col("l_shipdate")).alias("timestamp_ms"))


def tick_rows(spark, sf_dir):
    return W.table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % SESSIONS).cast("string").alias("session_id"),
        F.col("o_orderkey").alias("tick"))


_TICK_PACKETS = f"""{_P},
lists AS (SELECT session_id, tick, string_agg(packet_id || ':' || data_len || '@' || timestamp_ms, ','
            ORDER BY pos, packet_id, data_len, timestamp_ms) AS packets FROM packets GROUP BY ALL)
SELECT session_id, tick, 0 AS part, coalesce(packets, '') AS packets
FROM ticks LEFT JOIN lists USING (session_id, tick)"""


def packet_text(packets_column):
    return F.array_join(F.transform(packets_column, lambda p: F.concat(
        p["id"].cast("string"), F.lit(":"), p["len"].cast("string"), F.lit("@"),
        p["timestamp_ms"].cast("string"))), ",")


@query("tick_packets", _TICK_PACKETS)
def tick_packets(spark, sf_dir):
    joined = packets.tick_packets(tick_rows(spark, sf_dir), packet_rows(spark, sf_dir))
    return joined.withColumn("packets", packet_text("packets"))


@query("first_tick_packets", f"""{_P}
SELECT session_id, tick, pos, CAST(packet_id AS INTEGER) AS packet_id, data_len FROM packets JOIN (
  SELECT session_id, min(tick) AS tick FROM packets GROUP BY ALL) USING (session_id, tick)""")
def first_tick_packets(spark, sf_dir):
    """The packets of each session's first tick that has any."""
    rows = packet_rows(spark, sf_dir)
    wanted = rows.groupBy("session_id").agg(F.min("tick").alias("tick"))
    return (rows.join(wanted, ["session_id", "tick"], "left_semi")
            .select("session_id", "tick", "pos", "packet_id", "data_len"))


@query("packets_of_tick", f"""{_P} SELECT session_id, tick, pos, CAST(packet_id AS INTEGER) AS packet_id, data_len
FROM packets WHERE session_id = '1' AND tick = 1""")
def packets_of_tick(spark, sf_dir):
    """One tick's packets, in the order of the log."""
    found = packets.packets_of(packet_rows(spark, sf_dir), "1", 1)
    return found.select("session_id", "tick", "pos", "packet_id", "data_len")


_NAMES = "CASE packet_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in PACKET_NAMES.items()) + " ELSE 'Unknown' END"


@query("packet_counts", f"""{_P} SELECT CAST(packet_id AS INTEGER) AS packet_id, {_NAMES} AS packet_name,
count(*) AS packets FROM packets GROUP BY packet_id ORDER BY packets DESC, packet_id""")
def packet_counts(spark, sf_dir):
    return packets.type_counts(packet_rows(spark, sf_dir))


@query("packet_bytes", f"""{_P} SELECT session_id, count(*) AS packets,
CAST(sum(data_len + {PACKET_HEADER_BYTES_V2}) AS BIGINT) AS bytes_read FROM packets GROUP BY ALL""")
def packet_bytes(spark, sf_dir):
    return packets.bytes_read(packet_rows(spark, sf_dir), PACKET_HEADER_BYTES_V2)
