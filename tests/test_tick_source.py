"""Tick logs as a data source and as a stream of landed files."""

from __future__ import annotations

import struct

import pytest

from tickframe.sources import binlogs, tick_source

RECORD = struct.Struct(">iqffffffiihbbiiffbbh")


def record(tick):
    return RECORD.pack(tick, tick * 50, 1.5, -2.0, tick / 4, 0.0, -90.0, 19.5, 20, 3, -7, 15, 1, 6000, 127, 0.5, -0.5, -1, 2, 0)


@pytest.fixture
def logs(tmp_path):
    for session, chunk, first, n, tail in (("a", 0, 0, 50, b""), ("a", 1, 50, 30, b"xyz"), ("b", 0, 0, 20, b""), ("0042", 0, 5, 0, b"")):
        folder = tmp_path / f"session_id={session}" / f"chunk_{chunk}"
        folder.mkdir(parents=True)
        (folder / "gamestate.bin").write_bytes(b"".join(record(first + k) for k in range(n)) + tail)
    return tmp_path


def test_rows_are_those_of_the_reader(spark, logs):
    tick_source.register(spark)
    source = spark.read.format("tick_log").option("splitBytes", 700).load(str(logs))
    want = binlogs.read_ticks(spark, str(logs))
    assert source.columns == want.columns and source.dtypes == want.dtypes
    assert sorted(source.collect()) == sorted(want.collect()) and source.count() == 100
    few = spark.read.format("tick_log").option("columns", "tick, health, session_id").load(str(logs))
    assert few.columns == ["session_id", "tick", "health"] and few.count() == 100
    assert spark.read.format("tick_log").load(str(logs / "none")).count() == 0


def test_conditions_leave_out_files_and_ranges(spark, logs):
    tick_source.register(spark)
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        source = spark.read.format("tick_log").option("splitBytes", 680).option("pushFilters", "true").load(str(logs))
        got = source.where("session_id = 'a' AND tick >= 12 AND tick < 55 AND hunger = 20")
        assert sorted(r.tick for r in got.collect()) == list(range(12, 55))
        text = got._jdf.queryExecution().executedPlan().toString()
        assert ">= 12" not in text and "< 55" not in text and "= a)" not in text and "= 20)" in text  # Spark keeps only what it must
        assert got.rdd.getNumPartitions() <= 5 + 3  # no file of another session
    finally:
        spark.conf.unset(key)
    few = spark.read.format("tick_log").option("minTick", 12).option("maxTick", 54).load(str(logs))
    assert few.count() == 43 + 8
    options = {"path": str(logs), "splitbytes": "680", "mintick": "12", "maxtick": "54"}
    reader = tick_source.TickLogReader(tick_source.TickLogSource(options).schema(), options)
    read = [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()]
    assert sum(read) == 43 + 8 and 0 in read


def test_landed_logs_are_read_once(spark, logs, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        query = (binlogs.stream_ticks(spark, str(logs), split_bytes=700).writeStream.format("parquet").option("path", str(out / "rows"))
                 .option("checkpointLocation", str(out / "c")).trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.read.parquet(str(out / "rows"))

    assert run().count() == 100
    folder = logs / "session_id=c" / "chunk_0"
    folder.mkdir(parents=True)
    (folder / "gamestate.bin").write_bytes(record(7) + record(8))
    rows = run()
    assert rows.count() == 102 and sorted(r.tick for r in rows.where("session_id = 'c'").collect()) == [7, 8]


def test_many_small_ranges_share_a_task(tmp_path, monkeypatch):
    monkeypatch.setattr(tick_source, "_FEW", 4)
    for s in range(30):
        folder = tmp_path / f"session_id={s}" / "chunk_0"
        folder.mkdir(parents=True)
        (folder / "gamestate.bin").write_bytes(b"".join(record(k) for k in range(25)))
    options = {"path": str(tmp_path), "splitbytes": "680"}
    reader = tick_source.TickLogReader(tick_source.TickLogSource(options).schema(), options)
    parts = reader.partitions()
    assert len(parts) == 4  # 90 ranges
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) == 4 and sum(b.num_rows for b in batches) == 750
    got = sorted((r["session_id"], r["chunk_index"], r["tick"]) for b in batches for r in b.select(["session_id", "chunk_index", "tick"]).to_pylist())
    assert got == sorted((str(s), 0, k) for s in range(30) for k in range(25))
    monkeypatch.setattr(tick_source, "_TASK_BYTES", 700)
    assert len(reader.partitions()) == 90  # no two of 10 records fit into 700 bytes, nor 10 after 5
