"""Record borders found block by block, against the walk from the beginning."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickframe.plans.encoders import pack_event, pack_packet
from tickframe.sources import binlogs, borders
from tickframe.sources.listing import list_files


def made_up(kind, number, seed=3):
    """Records with bodies of many sizes, also ones that look like headers of huge records."""
    rng = random.Random(seed)
    for k in range(number):
        if kind == "event":
            yield pack_event(rng.randint(-5, 1 << 30), rng.randint(0, 7), "x" * rng.choice([0, 1, 9, 255]), rng.randint(-9, 9), k % 30000)
        else:
            size = rng.choice([0, 3, 40, 700, 5000 if k % 9 == 0 else 1])
            yield pack_packet(int(kind[-1]), k // 2, k, rng.randint(0, 9), bytes(rng.choice([0, 255, 7, 1]) for _ in range(size)))


KINDS = ("event", "packet_v1", "packet_v2")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("cut", [0, 3])
@pytest.mark.parametrize("block", [50, 333, 1 << 20])
def test_every_entry_of_a_block_leads_where_the_walk_leads(kind, cut, block):
    log = b"".join(made_up(kind, 120))
    log = log[:len(log) - cut]
    for begin in range(0, len(log), max(block, len(log) // 7)):
        size = min(block, len(log) - begin)
        room = len(log) - begin
        data = np.frombuffer(log[begin:begin + min(room, size + 14)], np.uint8)
        exits, counts = borders.block_map(data, size, room, kind)
        for entry in range(0, len(exits), 7):
            starts, end = borders.record_starts(log, kind, begin + entry, begin + size)
            assert counts[entry] == len(starts)
            if end < begin + size:  # the records stop within the block
                assert exits[entry] == -1 - (end - begin)
            else:
                assert exits[entry] == end - begin


def files_of(spark, folder, kind):
    return list_files(spark, str(folder), "log.bin").withColumn("format", F.lit(kind))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("block, entries", [(97, 1 << 16), (2000, 40), (4096, 1 << 16)])
def test_pieces_cover_the_files(spark, tmp_path, kind, block, entries):
    logs = {}
    for k, (number, cut) in enumerate([(200, 0), (60, 2), (1, 0), (0, 0), (90, 5)]):
        data = b"".join(made_up(kind, number, k))
        logs[f"s{k}"] = data[:len(data) - cut]
        (tmp_path / f"session_id=s{k}").mkdir()
        (tmp_path / f"session_id=s{k}" / "log.bin").write_bytes(logs[f"s{k}"])
    found = {}
    for r in borders.pieces(files_of(spark, tmp_path, kind), block, entries).collect():
        found.setdefault(r.session_id, []).append((r.offset, r.size, r.first_pos, r.records))
    for name, log in logs.items():
        starts, end = borders.record_starts(log, kind)
        at, pos, begins = 0, 0, set(starts.tolist())
        for offset, size, first, number in sorted(found.get(name, [])):
            assert offset == at and first == pos and offset in begins
            assert number == sum(offset <= s < offset + size for s in starts)
            at, pos = offset + size, pos + number
        assert at == end and pos == len(starts)
        if len(log) > 3 * block and entries > 1000 and kind == "event":
            assert len(found[name]) > 2


@pytest.mark.parametrize("split_bytes", [None, 100, 3000])
def test_logs_read_in_any_pieces(spark, tmp_path, split_bytes):
    folder = tmp_path / "session_id=s"
    folder.mkdir()
    events, packets = list(made_up("event", 150)), list(made_up("packet_v2", 150))
    (folder / "gamestate_events.bin").write_bytes(b"".join(events) + b"\0" * 4)
    (folder / "packets.bin").write_bytes(b"".join(packets)[:-1])
    (folder / "packets_v2.marker").write_bytes(b"")
    got = binlogs.read_events(spark, str(tmp_path), split_bytes=split_bytes)
    assert sorted(pack_event(r.tick, r.event_type, r.item_name, r["count"], r.prev_count) for r in got.collect()) == sorted(events)
    back = binlogs.read_packets(spark, str(tmp_path), split_bytes=split_bytes).orderBy("pos").collect()
    whole = packets if not packets[-1] else packets[:-1]
    assert [r.pos for r in back] == list(range(len(whole)))
    assert [pack_packet(2, r.tick, r.timestamp_ms, r.packet_id, bytes(r.data)) for r in back] == whole
    covered = rows(binlogs.log_coverage(binlogs.packet_files(spark, str(tmp_path)), split_bytes).select("records", "bytes_read", "trailing_bytes"))
    read = sum(map(len, whole))
    assert covered == [(len(whole), read, len(b"".join(packets)) - 1 - read)]


def test_maps_are_small_and_come_in_few_batches(spark, tmp_path):
    for n in range(20):
        folder = tmp_path / f"session_id={n}"
        folder.mkdir()
        (folder / "log.bin").write_bytes(b"".join(pack_event(t, 0, "stick", 1, 0) for t in range(100)))
    maps = borders.block_maps(list_files(spark, str(tmp_path), "log.bin").withColumn("format", F.lit("event")), 512)
    widths = {(len(r["exits"]) // r["size"], len(r["counts"]) // r["size"]) for r in maps.collect()}
    assert widths == {(2, 1)}  # 16 bytes for each byte of a log before
    files = maps.select("path", F.spark_partition_id().alias("task")).groupBy("path").agg(F.count_distinct("task").alias("tasks")).collect()
    assert len(files) == 20 and {r["tasks"] for r in files} == {1}  # a small file is opened by one task


def test_narrow_numbers_are_the_same():
    for values in ([], [0], [-128, 127], [-129, 5], [40_000], [-1 - (1 << 40), 3]):
        data = borders._narrow(np.array(values, np.int64))
        assert borders._wide(data, len(values)).tolist() == values
