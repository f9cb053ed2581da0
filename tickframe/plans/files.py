"""Scans of log files that Spark has written from whole tables: read back in pieces, every byte accounted for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import packets
from tickframe.plans import encoders
from tickframe.plans import workload as W
from tickframe.plans.formats import CHUNK_ROWS, encoded_capture
from tickframe.plans.registry import query
from tickframe.schemas import CAPTURE_HEADER_BYTES, EVENT_HEADER_BYTES, EVENT_TAIL_BYTES, PACKET_HEADER_BYTES_V1, PACKET_HEADER_BYTES_V2
from tickframe.sinks import tables
from tickframe.sinks.shared import new_shared_path, write_shared
from tickframe.sources import binlogs, tick_source

_T = f"WITH {W.TELEMETRY_SQL}"
# So small that most logs are cut.
PIECE_BYTES = 512


def _cut(content, session, keep: int):
    """Every fourth session's logs end in the middle of a record."""
    return F.when(session.cast("long") % 4 == 0, F.concat(content, F.unhex(F.lit("00" * keep)))).otherwise(content)


def _land(logs, spark, kind: str, name: str, tail: int) -> str:
    root = new_shared_path(spark, kind)
    content = _cut(F.col("content"), F.col("session_id"), tail)
    encoders.write_files(logs.withColumn("content", content), root, name)
    return root


def _one_log(spark, sf_dir):
    return W.telemetry(spark, sf_dir).withColumn("chunk_index", F.lit(0))


@query("tick_log_files", f"""{_T},
n AS (SELECT session_id, count(*) AS ticks, CAST(sum(ord) AS BIGINT) AS tick_sum, CAST(sum(k) AS BIGINT) AS hunger_sum FROM tele GROUP BY ALL)
SELECT *, CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN 7 ELSE 0 END AS trailing_bytes FROM n""")
def tick_log_files(spark, sf_dir):
    """One tick log per session, read in ranges of a few records."""
    rows = _one_log(spark, sf_dir).select("session_id", "chunk_index", F.col("ord").alias("tick"), F.col("k").alias("hunger"))
    root = _land(encoders.encode_ticks(rows), spark, "tick-logs", "gamestate.bin", 7)
    ticks = binlogs.read_ticks(spark, root, split_bytes=PIECE_BYTES)
    rejected = binlogs.tick_rejects(spark, root).select("session_id", "trailing_bytes")
    return (ticks.groupBy("session_id").agg(F.count("*").alias("ticks"), F.sum(F.col("tick").cast("long")).alias("tick_sum"),
                                            F.sum(F.col("hunger").cast("long")).alias("hunger_sum"))
            .join(rejected, "session_id", "left").na.fill(0, ["trailing_bytes"]).withColumn("trailing_bytes", F.col("trailing_bytes").cast("int")))


@query("tick_log_source", f"""{_T}
SELECT session_id, count(*) AS ticks, CAST(sum(k) AS BIGINT) AS hunger_sum, CAST(max(ord) AS INTEGER) AS last_tick
FROM tele WHERE ord BETWEEN 5 AND 40 GROUP BY ALL""")
def tick_log_source(spark, sf_dir):
    """The same logs through the data source: three columns of the ticks 5 to 40, ranges without any of them not read."""
    rows = _one_log(spark, sf_dir).select("session_id", "chunk_index", F.col("ord").alias("tick"), F.col("k").alias("hunger"))
    root = _land(encoders.encode_ticks(rows), spark, "tick-source", "gamestate.bin", 7)
    tick_source.register(spark)
    ticks = (spark.read.format("tick_log").option("columns", "session_id,tick,hunger").option("minTick", 5).option("maxTick", 40)
             .option("splitBytes", 8 * PIECE_BYTES).load(root))
    return ticks.groupBy("session_id").agg(F.count("*").alias("ticks"), F.sum(F.col("hunger").cast("long")).alias("hunger_sum"),
                                           F.max("tick").alias("last_tick"))


_NAME_BYTES = "CASE WHEN k % 10 = 0 THEN 255 ELSE 5 + strlen(CAST(k AS VARCHAR)) END"


@query("event_log_files", f"""{_T}
SELECT session_id, count(*) AS records, CAST(sum({EVENT_HEADER_BYTES + EVENT_TAIL_BYTES} + {_NAME_BYTES}) AS BIGINT) AS bytes_read,
  CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN 5 ELSE 0 END AS trailing_bytes,
  count(*) FILTER (k % 8 = 4) AS moves, CAST(sum(ord) AS BIGINT) AS prev_sum, count(*) FILTER (k % 10 = 0) AS cut_names
FROM tele GROUP BY ALL""")
def event_log_files(spark, sf_dir):
    """One event log per session, its record borders found in pieces of a few records."""
    name = F.when(F.col("k") % 10 == 0, F.expr("repeat('é', 130)")).otherwise(F.concat(F.lit("item_"), F.col("k").cast("string")))
    rows = _one_log(spark, sf_dir).select(
        "session_id", "chunk_index", "ord", "tick", (F.col("k") % 8).alias("event_type"), name.alias("item_name"),
        (F.col("k") - 50).alias("count"), F.col("ord").alias("prev_count"))
    root = _land(encoders.encode_events(rows, "ord"), spark, "event-logs", "gamestate_events.bin", 5)
    read = tables.label_events(binlogs.read_events(spark, root, split_bytes=PIECE_BYTES))
    covered = binlogs.log_coverage(binlogs.event_files(spark, root), PIECE_BYTES)
    return (read.groupBy("session_id").agg(
        F.count_if(F.col("event_type") == "DIMENSION_CHANGE").alias("moves"), F.sum(F.col("prev_count").cast("long")).alias("prev_sum"),
        F.count_if(F.col("item_name").endswith("\ufffd")).alias("cut_names"))
        .join(covered.select("session_id", "records", "bytes_read", F.col("trailing_bytes").cast("int").alias("trailing_bytes")), "session_id"))


@query("packet_log_files", f"""{_T},
p AS (SELECT *, CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN {PACKET_HEADER_BYTES_V2} ELSE {PACKET_HEADER_BYTES_V1} END AS header,
        strlen(event_type || k) * (1 + (k % 5) * 20) AS size FROM tele)
SELECT session_id, count(*) AS packets, CAST(sum(header + size) AS BIGINT) AS bytes_read,
  CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN 3 ELSE 0 END AS trailing_bytes, CAST(sum(size) AS BIGINT) AS payload_bytes,
  CAST(sum(ord * (k % 10)) AS BIGINT) AS place_sum, count(*) FILTER (header = {PACKET_HEADER_BYTES_V2}) AS stamped FROM p GROUP BY ALL""")
def packet_log_files(spark, sf_dir):
    """Packet logs of both versions, read in pieces shorter than some packets; covered bytes against the files' length."""
    rows = _one_log(spark, sf_dir).select(
        "session_id", "chunk_index", "ord", "tick", (F.col("event_id") % 100000).alias("timestamp_ms"), (F.col("k") % 10).alias("packet_id"),
        F.encode(F.expr("repeat(concat(event_type, cast(k AS string)), cast(1 + (k % 5) * 20 AS int))"), "UTF-8").alias("data"))
    new = F.col("session_id").cast("long") % 2 == 0
    logs = [encoders.encode_packets(rows.where(new), "ord", 2), encoders.encode_packets(rows.where(~new), "ord", 1)]
    root = _land(logs[0].unionByName(logs[1]), spark, "packet-logs", "packets.bin", 3)
    markers = rows.where(new).select("session_id", "chunk_index", F.lit(b"").alias("content")).distinct()  # one per log
    encoders.write_files(markers, root, "packets_v2.marker")
    read = binlogs.read_packets(spark, root, split_bytes=PIECE_BYTES)
    covered = binlogs.log_coverage(binlogs.packet_files(spark, root), PIECE_BYTES)
    return (read.groupBy("session_id").agg(
        F.count("*").alias("packets"), F.sum(F.octet_length("data").cast("long")).alias("payload_bytes"),
        F.sum(F.col("pos") * F.col("packet_id")).alias("place_sum"), F.count("timestamp_ms").alias("stamped"))
        .join(covered.select("session_id", "bytes_read", F.col("trailing_bytes").cast("int").alias("trailing_bytes")), "session_id"))


@query("capture_files", f"""{_T},
c AS (SELECT session_id, ord // {CHUNK_ROWS} AS chunk, count(*) AS n, CAST(session_id AS BIGINT) % 5 AS kind FROM tele GROUP BY ALL)
SELECT session_id, ['ok', 'short', 'codec', 'block', 'over-counted'][kind + 1] AS outcome, count(*) AS files,
  CAST(sum(CASE WHEN kind IN (0, 2, 4) THEN n ELSE 0 END) AS BIGINT) AS ticks,
  CAST(sum(CASE kind WHEN 0 THEN n WHEN 1 THEN NULL WHEN 4 THEN n + 3 ELSE n END) AS BIGINT) AS declared, true AS whole
FROM c GROUP BY ALL""")
def capture_files(spark, sf_dir):
    """Capture files of which four in five are damaged: what became of each, and the ticks that came out of it."""
    content, kind = F.hex("content"), F.col("session_id").cast("long") % 5
    patch = lambda offset, text, size: F.overlay(content, text, 2 * offset + 1, 2 * size)
    count = F.hex(F.substring("content", 11, 1))
    number = F.conv(F.concat(F.hex(F.substring("content", 12, 1)), count), 16, 10).cast("int") + 3
    more = F.lpad(F.hex(number), 4, "0")
    damaged = (F.when(kind == 1, F.substring(content, 1, 40)).when(kind == 2, patch(12, F.lit("02"), 1))
               .when(kind == 3, F.concat(F.substring(content, 1, 2 * CAPTURE_HEADER_BYTES + 8), F.lit("F0FFFFFF")))
               .when(kind == 4, patch(10, F.concat(F.substring(more, 3, 2), F.substring(more, 1, 2)), 2)).otherwise(content))
    root = new_shared_path(spark, "captures")
    logs = encoded_capture(spark, sf_dir).select(
        "session_id", F.regexp_extract("path", r"chunk_index=(\d+)", 1).cast("int").alias("chunk_index"), F.unhex(damaged).alias("content"))
    encoders.write_files(logs, root, "chunk.cap")
    tagged = write_shared(binlogs.read_capture_tagged(spark, root), "captured")
    found = binlogs.captured_ticks(tagged).groupBy("path").agg(F.count("*").alias("ticks"))
    # The listing knows the length of every file, whatever was read of it.
    length = binlogs.list_files(spark, root, "chunk.cap").select("path", "length")
    return (binlogs.captured_files(tagged).join(found, "path", "left").join(length, "path").groupBy("session_id", "outcome").agg(
        F.count("*").alias("files"), F.sum(F.coalesce("ticks", F.lit(0))).alias("ticks"), F.sum(F.col("declared").cast("long")).alias("declared"),
        F.bool_and((F.col("file_bytes") == F.col("length")) & (F.col("records") == F.coalesce("ticks", F.lit(0)))).alias("whole")))


@query("overlapping_export", f"""{_T},
c AS (SELECT session_id, ord // {CHUNK_ROWS} AS chunk, min(ord) AS first, count(*) AS n FROM tele GROUP BY ALL),
r AS (SELECT session_id, first + row AS tick, chunk, row FROM c, (SELECT unnest(range({CHUNK_ROWS})) AS row) WHERE row < n
      UNION ALL SELECT session_id, first + row, chunk + 1000, row FROM c, (SELECT unnest(range({CHUNK_ROWS})) AS row) WHERE row < n AND chunk % 2 = 0),
refs AS (SELECT session_id, tick, count(*) AS n, count(*) // 2 + count(*) % 2 AS parts FROM tele GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY session_id, tick ORDER BY chunk) AS k FROM r)
SELECT b.session_id, count(*) AS lines, CAST(sum(CASE WHEN k = 1 THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS packets,
  count(*) FILTER (k = 1 AND n > 0) AS with_packets FROM best b LEFT JOIN refs USING (session_id, tick) GROUP BY ALL""")
def overlapping_export(spark, sf_dir):
    """Written JSON read back: half of the chunks lie twice, and a tick's packets go to its first row only."""
    captured = binlogs.decode_capture(encoded_capture(spark, sf_dir), content="content")
    number = F.regexp_extract("path", r"chunk_index=(\d+)", 1).cast("int")
    again = captured.where(number % 2 == 0).withColumn("place", F.col("place").withField("path", F.concat(F.lit("~"), F.col("path"))))
    logged = W.telemetry(spark, sf_dir).select(
        "session_id", "tick", F.col("ord").alias("pos"), (F.col("k") % 10).alias("packet_id"), F.col("k").cast("long").alias("data_len"),
        F.lit(None).cast("long").alias("timestamp_ms"))
    path = new_shared_path(spark, "export")
    tables.write_export(tables.export_rows(packets.tick_packets(captured.unionByName(again), logged)), path)
    lines = spark.read.option("basePath", path).schema("session_id string, tick long, packets array<struct<id:int,len:bigint>>").json(path)
    size = F.size("packets")
    return lines.groupBy("session_id").agg(F.count("*").alias("lines"), F.sum(size).cast("long").alias("packets"),
                                           F.count_if(size > 0).alias("with_packets"))
