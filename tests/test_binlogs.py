"""Readers of the binary formats on files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickframe import schemas as S
from tickframe.functions import labels
from tickframe.operators import chunks, packets
from tickframe.plans.encoders import pack_capture, pack_event, pack_packet
from tickframe.sinks import tables
from tickframe.sources import binlogs, documents, listing

TICK_FORMAT = ">iqffffffiihbbiiffbbh"
# Edges of every field: signs, extremes, an infinite coordinate.
DEFAULTS = dict(tick=0, timestamp_ms=(1 << 40) + 1, player_x=-0.0, player_y=float("inf"), player_z=1.5e-30,
                player_yaw=-179.5, player_pitch=89.75, health=0.25, hunger=-1, xp=(1 << 31) - 1, biome_id=-32768,
                light_level=-128, is_raining=1, time_of_day=23999, key_mask=127, yaw_delta=180.0,
                pitch_delta=0.125, dimension=-1, player_pose=5, _padding=32767)


def tick(**fields):
    return struct.pack(TICK_FORMAT, *{**DEFAULTS, **fields}.values())


def session(root, name="s-1"):
    folder = root / f"session_id={name}"
    folder.mkdir(parents=True)
    return folder


def test_record_is_68_bytes():
    assert struct.calcsize(TICK_FORMAT) == S.TICK_RECORD_BYTES == len(tick())


def test_one_tick(spark, tmp_path):
    (session(tmp_path) / "gamestate.bin").write_bytes(
        tick(tick=-9, player_z=float("nan"), player_x=-0.5, hunger=-(1 << 31)))
    row = binlogs.read_ticks(spark, str(tmp_path)).first()
    assert row.session_id == "s-1" and row.chunk_index is None
    assert (row.tick, row.timestamp_ms, row.hunger, row.xp) == (-9, (1 << 40) + 1, -(1 << 31), (1 << 31) - 1)
    assert (row.player_x, row.player_y, row.pitch_delta) == (-0.5, float("inf"), 0.125) and row.player_z != row.player_z
    assert (row.biome_id, row.light_level, row.dimension, row["_padding"]) == (-32768, -128, -1, 32767)


@pytest.mark.parametrize("split_bytes", [None, 68, 700])
def test_many_ticks_in_any_split(spark, tmp_path, split_bytes):
    (session(tmp_path) / "gamestate.bin").write_bytes(b"".join(tick(tick=i) for i in range(100)))
    back = binlogs.read_ticks(spark, str(tmp_path), split_bytes=split_bytes)
    assert [r.tick for r in back.orderBy("tick").select("tick").collect()] == list(range(100))


def test_empty_and_truncated_tick_logs(spark, tmp_path):
    (session(tmp_path, "empty") / "gamestate.bin").write_bytes(b"")
    (session(tmp_path, "cut") / "gamestate.bin").write_bytes(tick(hunger=-5) + b"\1" * 67)
    back = binlogs.read_ticks(spark, str(tmp_path))
    assert len(back.columns) == 2 + 20
    assert rows(back.select("session_id", "hunger")) == [("cut", -5)]
    assert dict(back.dtypes)["hunger"] == "int"
    assert rows(binlogs.tick_rejects(spark, str(tmp_path)).select("session_id", "length", "trailing_bytes")) == [
        ("cut", 135, 67)]


def test_missing_folder_or_log_gives_no_rows(spark, tmp_path):
    assert binlogs.read_ticks(spark, str(tmp_path / "nowhere")).count() == 0
    folder = session(tmp_path)
    (folder / "gamestate_events.bin").write_bytes(pack_event(0, 3, "bed", 0, 0))
    assert binlogs.read_ticks(spark, str(tmp_path)).count() == 0
    assert binlogs.read_events(spark, str(tmp_path)).count() == 1
    table = documents.read_session_table(spark, str(tmp_path / "none"), S.EVENTS)
    assert table.count() == 0 and "session_id" in table.columns


# Empty and longest names, extreme numbers, types of the later kind.
EVENTS = [(-3, 0, "", -32768, 32767), (0, 4, "mod:sky", 0, 0), (7, 5, "ender_dragon", 10000, -1), ((1 << 31) - 1, 6, "n" * 255, 1, 0)]


@pytest.mark.parametrize("split_bytes", [None, 1, 40])
def test_many_events_in_any_split(spark, tmp_path, split_bytes):
    (session(tmp_path) / "gamestate_events.bin").write_bytes(b"".join(pack_event(*e) for e in EVENTS))
    back = binlogs.read_events(spark, str(tmp_path), split_bytes=split_bytes)
    assert rows(back.select(*S.EVENTS.names), "tick") == EVENTS


@pytest.mark.parametrize("split_bytes", [None, 1])
def test_truncated_event_log(spark, tmp_path, split_bytes):
    (session(tmp_path) / "gamestate_events.bin").write_bytes(pack_event(*EVENTS[0]) + b"\0\0\0")
    assert binlogs.read_events(spark, str(tmp_path), split_bytes=split_bytes).count() == 1
    rejected = binlogs.event_rejects(spark, str(tmp_path), split_bytes=split_bytes)
    assert rows(rejected.select("trailing_bytes")) == [(3,)]


def test_name_cut_inside_a_letter_is_repaired(spark, tmp_path):
    (session(tmp_path) / "gamestate_events.bin").write_bytes(pack_event(1, 7, "é" * 200, 0, 0))
    name, = binlogs.read_events(spark, str(tmp_path)).select("item_name").first()
    assert name == "é" * 127 + "�"


def test_labels_strict_and_full(spark):
    codes = spark.range(8).select(F.col("id").cast("int").alias("event_type"))
    full = [r[0] for r in tables.label_events(codes).collect()]
    assert full == list(S.EVENT_TYPES.values())
    v1 = spark.range(4).select(labels.event_label(F.col("id"), "strict_v1"))
    assert v1.count() == 4 and v1.collect()[3][0] == "SLEPT"
    with pytest.raises(Exception, match="unknown event type [4-7]"):
        codes.select(labels.event_label(F.col("event_type"), "strict_v1")).collect()
    with pytest.raises(Exception, match="unknown event type 9"):
        spark.range(9, 10).select(labels.event_label(F.col("id"))).collect()


def test_conversion_to_parquet_and_back(spark, tmp_path):
    raw, out = tmp_path / "in", tmp_path / "out"
    folder = session(raw, "0042")
    (folder / "gamestate.bin").write_bytes(b"".join(tick(tick=i) for i in range(5)))
    (folder / "gamestate_events.bin").write_bytes(
        pack_event(0, 1, "plank", 4, 0) + pack_event(2, 0, "", -1, 32767))
    tables.write_by_session(binlogs.read_ticks(spark, str(raw)), str(out / "ticks"))
    tables.write_events(binlogs.read_events(spark, str(raw)), str(out / "events"), labels_mode="strict_v1")
    # An all-digit id stays text.
    ticks = documents.read_session_table(spark, str(out / "ticks"), S.TICKS)
    assert rows(ticks.select("session_id", "tick"), "tick") == [("0042", i) for i in range(5)]
    events = spark.read.parquet(str(out / "events"))
    assert rows(events.select("event_type", "item_name", "count", "prev_count"), "tick") == [
        ("CRAFTED", "plank", 4, 0), ("INVENTORY_DELTA", "", -1, 32767)]


# --- capture chunks and packets ---------------------------------------------

def capture_record(tick_no, flags=0, mouse=0, yaw=0, pitch=0, x=0.0):
    return struct.pack("<HBBhhIffffBBHfffhh", flags, 3, mouse, yaw, pitch, tick_no,
                       x, 64.0, -2.0, 20.0, 18, 0, 5, 0.0, -0.5, 0.25, 512, -3)


def old_record(tick_no, yaw, pitch):
    return struct.pack("<HBhhI", 9, 4, yaw, pitch, tick_no) + b"\0" * 17


@pytest.fixture
def captured(tmp_path):
    """Two good chunks, then one short, one with bad magic, codec, CRC and payload each."""
    folder = tmp_path / "s-7" / "chunks"
    folder.mkdir(parents=True)
    good = pack_capture(10, b"".join(capture_record(10 + i, flags=1 << i, yaw=4500, pitch=-1000, x=i)
                                     for i in range(3)), 3)
    (folder / "000000.cap").write_bytes(good)
    (folder / "000001.cap").write_bytes(pack_capture(13, capture_record(99, mouse=5), 1))
    (folder / "000002.cap").write_bytes(good[:20])
    (folder / "000003.cap").write_bytes(b"XCAP" + good[4:])
    (folder / "000004.cap").write_bytes(good[:12] + b"\x07" + good[13:])
    (folder / "000005.cap").write_bytes(good[:21] + b"\0\0\0\0" + good[25:])
    broken = struct.pack("<I", 144) + b"\xff\xff\xff"
    (folder / "000006.cap").write_bytes(good[:21] + struct.pack("<I", zlib.crc32(broken)) + broken)
    return tmp_path


def test_chunk_headers_and_status(spark, captured):
    found = binlogs.read_chunk_headers(spark, str(captured))
    status = [r[0] for r in found.orderBy("path").select("status").collect()]
    assert status == ["ok", "ok", "short", "magic", "codec", "crc", "ok"]
    first = found.orderBy("path").first()
    assert (first.session_id, first.schema_version, first.start_tick, first.tick_count, first.codec,
            first.uncompressed_len) == ("s-7", 1, 10, 3, 1, 144)
    index = chunks.index_from_headers(found.where("status = 'ok'"))
    assert rows(index.select("start_tick", "end_tick"), "path")[:2] == [(10, 12), (13, 13)]
    assert rows(chunks.max_tick(index)) == [(13,)]
    assert rows(chunks.max_tick(index.where("false"))) == [(-1,)]


def test_capture_ticks_are_positional(spark, captured):
    ticks = binlogs.read_capture_chunks(spark, str(captured), verify=True)
    assert rows(ticks.select("tick", "recorded_tick", "flags", "x"), "tick") == [
        (10, 10, 1, 0.0), (11, 11, 2, 1.0), (12, 12, 4, 2.0), (13, 99, 0, 0.0)]
    # Without verification only chunks that do not decompress are skipped, as an export does.
    tolerant = binlogs.read_capture_chunks(spark, str(captured))
    assert tolerant.select("path").distinct().count() == 5


def test_old_records_are_detected(spark, tmp_path):
    folder = tmp_path / "s-8" / "chunks"
    folder.mkdir(parents=True)
    (folder / "a.cap").write_bytes(pack_capture(5, b"".join(
        old_record(5 + i, -100 * i, 250) for i in range(3)), 3))
    # 336 bytes are 7 new or 12 old records; the new size is tried first.
    (folder / "b.cap").write_bytes(pack_capture(0, b"".join(capture_record(i) for i in range(7)), 7))
    back = binlogs.read_capture_chunks(spark, str(tmp_path), detect_size=True)
    assert rows(back.where("record_size = 28").select("tick", "recorded_tick", "flags", "hotbar", "yaw_fp", "pitch_fp", "x"),
                "tick") == [(5, 5, 9, 4, 0, 250, None), (6, 6, 9, 4, -100, 250, None), (7, 7, 9, 4, -200, 250, None)]
    assert back.where("record_size = 48").count() == 7


@pytest.fixture
def packet_logs(tmp_path):
    log = [(0, 100, 5, b"abc"), (0, 101, 6, b""), (2, 102, 300, b"\x01" * 40)]
    for name, version in (("new", 2), ("old", 1)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "packets.bin").write_bytes(
            b"".join(pack_packet(version, *p) for p in log) + pack_packet(version, 3, 0, 1, b"xyz")[:-1])
    (tmp_path / "new" / "packets_v2.marker").write_bytes(b"v2")
    return tmp_path


@pytest.mark.parametrize("split_bytes", [None, 1, 30])
def test_packet_logs_of_both_versions(spark, packet_logs, split_bytes):
    back = binlogs.read_packets(spark, str(packet_logs), split_bytes=split_bytes)
    columns = ["pos", "tick", "timestamp_ms", "packet_id", "data_len"]
    assert rows(back.where("session_id = 'new'").select(*columns), "pos") == [
        (0, 0, 100, 5, 3), (1, 0, 101, 6, 0), (2, 2, 102, 300, 40)]
    assert rows(back.where("session_id = 'old'").select(*columns), "pos") == [
        (0, 0, None, 5, 3), (1, 0, None, 6, 0), (2, 2, None, 300, 40)]
    assert bytes(back.where("pos = 0").first().data) == b"abc"
    assert binlogs.packet_rejects(spark, str(packet_logs), split_bytes).count() == 2
    read = packets.bytes_read(back.where("session_id = 'new'"), S.PACKET_HEADER_BYTES_V2).first()
    assert read.bytes_read == 3 * 14 + 43


def test_export_lines(spark, captured, packet_logs, tmp_path):
    (captured / "s-7" / "packets.bin").write_bytes(
        pack_packet(1, 10, 0, 5, b"abc") + pack_packet(1, 10, 0, 6, b"") + pack_packet(1, 12, 0, 1, b"z"))
    ticks = binlogs.read_capture_chunks(spark, str(captured), verify=True)
    logged = binlogs.read_packets(spark, str(captured / "s-7"), payload=False)
    out = str(tmp_path / "export")
    tables.write_export(tables.export_rows(packets.tick_packets(ticks, logged)), out)
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert len(lines) == 4
    first = next(line for line in lines if line.startswith('{"tick":10,'))
    # Version 1 has no packet time, and the key is left out.
    assert first.endswith('"packets":[{"id":5,"len":3},{"id":6,"len":0}]}')
    assert '"flags":{"forward":true,"back":false,' in first and '"yaw":45.0,"pitch":-10.0' in first
    assert '"cursor":[512,-3]' in first and '"use":false' in first
    assert next(line for line in lines if line.startswith('{"tick":11,')).endswith('"packets":[]}')


def test_packets_go_to_the_first_row_of_a_tick(spark):
    ticks = spark.createDataFrame([("s", 4, 0), ("s", 4, 1), ("s", 5, 2)], "session_id string, tick long, row_in_log long")
    logged = spark.createDataFrame([("s", 4, 0, 1, 2, None)],
                                   "session_id string, tick long, pos long, packet_id int, data_len long, timestamp_ms long")
    joined = packets.tick_packets(ticks, logged).select("row_in_log", F.size("packets"))
    assert rows(joined, "row_in_log") == [(0, 1), (1, 0), (2, 0)]


def test_hot_tick_is_split_into_parts_without_loss(spark):
    logged = spark.range(10).select(F.lit("s").alias("session_id"), F.lit(4).cast("long").alias("tick"),
                                    F.col("id").alias("pos"), F.col("id").cast("int").alias("packet_id"),
                                    F.lit(1).cast("long").alias("data_len"), F.lit(None).cast("long").alias("timestamp_ms"))
    parts = packets.packet_lists(logged, part_packets=4).orderBy("part").collect()
    assert [[p.id for p in r.packets] for r in parts] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    whole = packets.packet_lists(logged, part_packets=20).collect()
    assert [[p.id for p in r.packets] for r in whole] == [list(range(10))]


def test_sessions_and_paths(spark, captured):
    found = listing.discover_sessions(spark, str(captured), "*.cap").first()
    assert (found.session_id, found.files) == ("s-7", 7)
    paths = spark.createDataFrame([
        ("file:/d/raw/session_id=a-b/chunk_index=3/x",), ("file:/d/sess/chunks/chunk_0012/gamestate.bin",),
        ("file:/d/sess/chunks/000001.cap",), ("file:/d/sess/packets.bin",)], "p string")
    assert rows(paths.select(listing.session_of(F.col("p")), listing.chunk_of(F.col("p")))) == [
        ("a-b", 3), ("sess", 12), ("sess", None), ("sess", None)]


def test_lz4_block_codec_is_there():
    assert pa.Codec.is_available("lz4_raw")


def test_bytes_of_a_column_are_not_copied():
    batch = pa.RecordBatch.from_pylist([{"session_id": str(k), "content": bytes([k]) * 1000} for k in range(5)])
    whole = batch.column("content").buffers()[2]
    found = list(binlogs._blocks(iter([batch]), "content"))
    assert [(row, bytes(data)) for row, data in found] == [({"session_id": str(k)}, bytes([k]) * 1000) for k in range(5)]
    places = [np.frombuffer(data, np.uint8).ctypes.data - whole.address for _, data in found]
    assert places == [0, 1000, 2000, 3000, 4000]  # views of the batch


def test_long_names_in_a_column():
    log = b"".join(pack_event(t, 0, "x" * 255, 1, 0) for t in range(3))
    batch = pa.RecordBatch.from_pylist([{"session_id": "s", "content": log}])
    (_, data), = binlogs._blocks(iter([batch]), "content")
    assert len(binlogs.borders.record_starts(data, "event")[0]) == 3
