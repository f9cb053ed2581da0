"""Readers of the binary formats, over logs that Spark encodes from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import packets
from tickframe.operators.chunks import index_from_headers
from tickframe.plans import encoders
from tickframe.plans import workload as W
from tickframe.plans.packets import packet_text
from tickframe.plans.registry import query
from tickframe.sinks import tables
from tickframe.sources import binlogs

CHUNK_ROWS = 256

_T = f"WITH {W.TELEMETRY_SQL}"


def _chunked(spark, sf_dir):
    return W.telemetry(spark, sf_dir).withColumn(
        "chunk_index", F.call_function("div", F.col("ord"), F.lit(CHUNK_ROWS)).cast("int"))


@query("tick_log_roundtrip", f"""{_T} SELECT session_id, CAST(ord AS INTEGER) AS tick,
event_id * 1000 AS timestamp_ms, CAST(CAST(value AS FLOAT) AS DOUBLE) AS player_x,
CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS player_yaw, CAST(k AS INTEGER) AS hunger,
CAST(k - 50 AS INTEGER) AS biome_id, k % 3 - 1 AS dimension, k * 1000 AS key_mask FROM tele""")
def tick_log_roundtrip(spark, sf_dir):
    rows = _chunked(spark, sf_dir).select(
        "session_id", "chunk_index", F.col("ord").alias("tick"),
        (F.col("event_id") * 1000).alias("timestamp_ms"), F.col("value").alias("player_x"),
        (F.col("value") / 3).alias("player_yaw"), F.col("k").alias("hunger"),
        (F.col("k") - 50).alias("biome_id"), (F.col("k") % 3 - 1).alias("dimension"),
        (F.col("k") * 1000).alias("key_mask"))
    back = binlogs.decode_tick_ranges(encoders.encode_ticks(rows), content="content")
    return back.select(
        "session_id", "tick", "timestamp_ms",
        *[F.col(c).cast("double").alias(c) for c in ("player_x", "player_yaw")], "hunger",
        *[F.col(c).cast("int").alias(c) for c in ("biome_id", "dimension", "key_mask")])


@query("event_log_roundtrip", f"""{_T} SELECT session_id, CAST(tick AS INTEGER) AS tick,
['INVENTORY_DELTA', 'CRAFTED', 'PLAYER_DIED', 'SLEPT', 'DIMENSION_CHANGE', 'DRAGON_HEALTH',
 'EQUIPMENT_CHANGE', 'ADVANCEMENT'][k % 8 + 1] AS event_type,
CASE WHEN k % 10 = 0 THEN repeat('é', 127) || chr(65533) ELSE 'item_' || k END AS item_name,
k - 50 AS count, CAST(ord AS INTEGER) AS prev_count FROM tele""")
def event_log_roundtrip(spark, sf_dir):
    """Every tenth name is longer than the format holds and is cut inside a letter."""
    name = F.when(F.col("k") % 10 == 0, F.expr("repeat('é', 130)")).otherwise(
        F.concat(F.lit("item_"), F.col("k").cast("string")))
    rows = _chunked(spark, sf_dir).select(
        "session_id", "chunk_index", "ord", "tick", (F.col("k") % 8).alias("event_type"),
        name.alias("item_name"), (F.col("k") - 50).alias("count"), F.col("ord").alias("prev_count"))
    back = tables.label_events(binlogs.decode_events(
        encoders.encode_events(rows, "ord"), content="content"))
    return back.select("session_id", "tick", "event_type", "item_name",
                       *[F.col(c).cast("int").alias(c) for c in ("count", "prev_count")])


_CAPTURE_FIELDS = {
    "flags": ("k * 81", "int"), "hotbar": ("k % 9", "int"), "mouse_btn": ("k % 8", "int"),
    "yaw_fp": ("k * 600 - 30000", "int"), "pitch_fp": ("k * 100 - 5000", "int"),
}


def _capture_rows(spark, sf_dir):
    ints = {n: F.expr(sql) for n, (sql, _) in _CAPTURE_FIELDS.items()}
    return _chunked(spark, sf_dir).select(
        "session_id", "chunk_index", F.col("ord").alias("tick"),
        (F.col("ord") + F.when(F.col("k") == 7, 1).otherwise(0)).alias("recorded_tick"),
        *[c.alias(n) for n, c in ints.items()],
        F.col("value").alias("x"), (F.col("value") / 2).alias("y"), (F.col("value") / 4).alias("z"),
        F.lit(20.0).alias("health"), (F.col("k") % 21).alias("food"), (F.col("k") % 3).alias("screen_type"),
        F.col("k").alias("xp_level"), (F.col("value") / 8).alias("vel_x"),
        (F.col("k") - 50).alias("cursor_x"), (50 - F.col("k")).alias("cursor_y"))


def encoded_capture(spark, sf_dir, old=False):
    return encoders.encode_capture(_capture_rows(spark, sf_dir), "tick", old)


_FIELD_SQL = ", ".join(f"CAST({sql} AS INTEGER) AS {n}" for n, (sql, _) in _CAPTURE_FIELDS.items())


@query("capture_roundtrip", f"""{_T} SELECT session_id, ord AS tick, ord + CAST(k = 7 AS INTEGER) AS recorded_tick,
{_FIELD_SQL}, CAST(CAST(value AS FLOAT) AS DOUBLE) AS x, k % 21 AS food, k AS xp_level, k - 50 AS cursor_x
FROM tele""")
def capture_roundtrip(spark, sf_dir):
    back = binlogs.decode_capture(encoded_capture(spark, sf_dir), content="content")
    return back.select("session_id", "tick", "recorded_tick",
                       *[F.col(n).cast("int").alias(n) for n in _CAPTURE_FIELDS],
                       F.col("x").cast("double").alias("x"),
                       *[F.col(n).cast("int").alias(n) for n in ("food", "xp_level", "cursor_x")])


# A payload of a multiple of 12 old records is also a multiple of 48 bytes, which is tried first.
@query("old_capture_roundtrip", f"""{_T},
sizes AS (SELECT session_id, ord // {CHUNK_ROWS} AS chunk_index, count(*) AS n FROM tele GROUP BY ALL)
SELECT session_id, ord AS tick, k % 9 AS hotbar, k * 600 - 30000 AS yaw_fp, k * 100 - 5000 AS pitch_fp
FROM tele JOIN sizes USING (session_id) WHERE ord // {CHUNK_ROWS} = chunk_index AND n % 12 <> 0""")
def old_capture_roundtrip(spark, sf_dir):
    back = binlogs.decode_capture(encoded_capture(spark, sf_dir, old=True), content="content",
                                  detect_size=True)
    return back.where(F.col("record_size") == 28).select(
        "session_id", "tick", *[F.col(n).cast("int").alias(n) for n in ("hotbar", "yaw_fp", "pitch_fp")])


@query("record_sizes", f"""{_T},
sizes AS (SELECT session_id, ord // {CHUNK_ROWS} AS chunk_index, count(*) AS records FROM tele GROUP BY ALL)
SELECT session_id, min(records) AS records, 48 AS record_size FROM sizes GROUP BY session_id, chunk_index""")
def record_sizes(spark, sf_dir):
    headers = binlogs.chunk_headers(encoded_capture(spark, sf_dir))
    return binlogs.payload_record_size(headers).select("session_id", "records", "record_size")


@query("chunk_headers", f"""{_T},
sizes AS (SELECT session_id, ord // {CHUNK_ROWS} AS chunk_index, min(ord) AS start_tick, count(*) AS tick_count
          FROM tele GROUP BY ALL)
SELECT session_id, start_tick, tick_count, start_tick + tick_count - 1 AS end_tick FROM sizes""")
def chunk_headers(spark, sf_dir):
    headers = binlogs.chunk_headers(encoded_capture(spark, sf_dir))
    return index_from_headers(headers).select(
        "session_id", "start_tick", (F.col("end_tick") - F.col("start_tick") + 1).alias("tick_count"),
        "end_tick")


@query("chunk_crc", f"""{_T} SELECT session_id, ord // {CHUNK_ROWS} AS chunk_index,
['ok', 'crc', 'magic', 'codec', 'short'][CAST(session_id AS BIGINT) % 5 + 1] AS status FROM tele GROUP BY ALL""")
def chunk_crc(spark, sf_dir):
    """Chunks of four sessions in five are damaged, each in another way."""
    content, kind = F.col("content"), F.col("session_id").cast("long") % 5
    hexed = F.hex(content)

    def patch(offset, byte):
        return F.unhex(F.overlay(hexed, F.lit(byte), 2 * offset + 1, 2))

    damaged = (F.when(kind == 1, F.unhex(F.concat(hexed, F.lit("00"))))
               .when(kind == 2, patch(0, "58")).when(kind == 3, patch(12, "02"))
               .when(kind == 4, F.substring(content, 1, 20)).otherwise(content))
    chunks = encoded_capture(spark, sf_dir).withColumn("content", damaged)
    number = F.regexp_extract("path", r"chunk_index=(\d+)", 1).cast("long")
    return binlogs.chunk_headers(chunks).select("session_id", number.alias("chunk_index"), "status")


def _packet_logs(spark, sf_dir, version):
    data = F.encode(F.concat(F.col("event_type"), F.col("k").cast("string")), "UTF-8")
    rows = _chunked(spark, sf_dir).select(
        "session_id", "chunk_index", "ord", "tick", (F.col("event_id") % 100000).alias("timestamp_ms"),
        (F.col("k") % 10).alias("packet_id"), data.alias("data"))
    logs = encoders.encode_packets(rows, "ord", version)
    return logs.withColumn("format", F.lit(f"packet_v{version}")).withColumn(
        "first_pos", F.col("chunk_index").cast("long") * CHUNK_ROWS)


def _packets_sql(stamp: str) -> str:
    return f"""{_T} SELECT session_id, ord AS pos, tick, {stamp} AS timestamp_ms, k % 10 AS packet_id,
CAST(strlen(event_type || k) AS BIGINT) AS data_len, event_type || k AS payload FROM tele"""


def _packet_columns(back):
    return back.select("session_id", "pos", "tick", "timestamp_ms", "packet_id", "data_len",
                       F.decode("data", "UTF-8").alias("payload"))


@query("packet_log_roundtrip", _packets_sql("event_id % 100000"))
def packet_log_roundtrip(spark, sf_dir):
    return _packet_columns(binlogs.decode_packets(_packet_logs(spark, sf_dir, 2), content="content"))


@query("packet_log_roundtrip_v1", _packets_sql("CAST(NULL AS BIGINT)"))
def packet_log_roundtrip_v1(spark, sf_dir):
    return _packet_columns(binlogs.decode_packets(_packet_logs(spark, sf_dir, 1), content="content"))


@query("tick_export", f"""{_T},
refs AS (SELECT session_id, tick, string_agg(k % 10 || ':' || strlen(event_type || k) || '@' || event_id % 100000, ','
           ORDER BY ord) AS packets FROM tele GROUP BY ALL)
SELECT session_id, ord AS tick, ((k * 81) & 1) = 1 AS forward, ((k * 81) & 1024) <> 0 AS "use",
  ((k * 81) & 4096) <> 0 AS in_water, (k & 4) <> 0 AS middle,
  CAST(CAST((k * 600 - 30000) / 100.0 AS FLOAT) AS DOUBLE) AS yaw,
  CAST(CAST(value / 4 AS FLOAT) AS DOUBLE) AS pos_z, 50 - k AS cursor_y, coalesce(packets, '') AS packets
FROM tele t LEFT JOIN refs r ON r.session_id = t.session_id AND r.tick = t.ord""".replace(
    "SELECT session_id, ord AS tick", "SELECT t.session_id, ord AS tick"))
def tick_export(spark, sf_dir):
    """Decoded capture ticks joined with decoded packets, in the nested export form."""
    ticks = binlogs.decode_capture(encoded_capture(spark, sf_dir), content="content")
    logged = binlogs.decode_packets(_packet_logs(spark, sf_dir, 2), content="content", payload=False)
    rows = tables.export_rows(packets.tick_packets(ticks, logged))
    return rows.select(
        "session_id", "tick", "flags.forward", "flags.use", "flags.in_water", "mouse_buttons.middle",
        F.col("yaw").cast("double").alias("yaw"), F.col("pos")[2].cast("double").alias("pos_z"),
        F.col("cursor")[1].cast("int").alias("cursor_y"), packet_text("packets").alias("packets"))
