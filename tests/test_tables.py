"""Writers, status ledgers and JSON documents."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from tickframe import schemas as S
from tickframe.operators import chunks
from tickframe.sinks import shared, tables
from tickframe.sources import documents, session_files


def test_session_folders_are_sorted_by_tick(spark, tmp_path):
    df = spark.range(50).select(F.when(F.col("id") < 40, "hot").otherwise("7").alias("session_id"),
                                (49 - F.col("id")).cast("int").alias("tick"))
    tables.write_by_session(df.repartition(3), str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["session_id=7", "session_id=hot"]
    schema = S.TICKS.__class__([f for f in S.TICKS if f.name == "tick"])
    assert documents.read_session_table(spark, str(tmp_path / "t"), schema).count() == 50
    found = chunks.tick_lookup(documents.read_session_table(spark, str(tmp_path / "t"), schema), "7", 3)
    assert rows(found.select("session_id", "tick")) == [("7", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tick,3)" in plan and "session_id#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_chunk_status_is_appended(spark, tmp_path):
    schema = "session_id string, chunk_index int, start_tick int, end_tick int, uploaded boolean, updated_at long"
    path = str(tmp_path / "status")
    tables.write_status(spark.createDataFrame([("s", 0, 0, 9, False, 1), ("s", 1, 10, 12, False, 2)], schema), path)
    tables.write_status(spark.createDataFrame([("s", 0, 0, 9, True, 3)], schema), path)
    now = tables.current_chunks(spark.read.parquet(path))
    assert rows(now.select("chunk_index", "end_tick", "uploaded"), "chunk_index") == [(0, 9, True), (1, 12, False)]


def test_session_status(spark, tmp_path):
    schema = "session_id string, status string, updated_at long"
    path = str(tmp_path / "status")
    tables.write_status(spark.createDataFrame([("s", "in_progress", 1), ("t", "in_progress", 1)], schema), path)
    tables.write_status(spark.createDataFrame([("s", "complete", 2)], schema), path)
    assert rows(tables.current_sessions(spark.read.parquet(path)).select("session_id", "status"), "session_id") == [
        ("s", "complete"), ("t", "in_progress")]


def test_rechunk_writes_and_indexes(spark, tmp_path):
    ticks = spark.range(10, 21).select(F.lit("s").alias("session_id"), F.col("id").alias("tick"))
    index = tables.write_chunked(ticks, str(tmp_path / "c"), size=4)
    assert rows(index.select("chunk_no", "start_tick", "end_tick", "tick_count"), "chunk_no") == [
        (0, 10, 13, 4), (1, 14, 17, 4), (2, 18, 20, 3)]


def test_summaries_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("r", None)], "run_id string, started_at_ms long")
    tables.write_summaries(df, str(tmp_path / "j"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()] == [
        {"run_id": "r", "started_at_ms": None}]


def test_manifests_and_ledgers(spark, tmp_path):
    session = tmp_path / "s-1"
    chunk = session / "chunks" / "chunk_0000"
    chunk.mkdir(parents=True)
    (session / "manifest.json").write_text(json.dumps(
        {"schema_version": 1, "mc_version": "1.20.1", "yarn": "1.20.1+build.10", "session_id": "s-1",
         "player_uuid": "u", "seed": -5, "game_mode": "SURVIVAL", "status": "complete"}, indent=2))
    (chunk / "manifest.json").write_text(json.dumps(
        {"session_id": "s-1", "chunk_index": 0, "start_tick": 0, "end_tick": 5999,
         "start_time_ms": 1000, "end_time_ms": 301000, "uploaded": False}, indent=2))
    (session / "session_manifest.json").write_text(json.dumps(
        {"session_id": "s-1", "player_id": "u", "started_at_ms": 1, "ended_at_ms": None, "total_chunks": 2,
         "chunks": [{"index": 0, "start_tick": 0, "end_tick": 5999, "uploaded": True},
                    {"index": 1, "start_tick": 6000, "end_tick": 6100, "uploaded": False}]}, indent=2))
    manifest = documents.read_session_manifests(spark, str(tmp_path)).collect()
    assert [(m.session_id, m.seed, m.status) for m in manifest] == [("s-1", -5, "complete")]
    found = documents.read_chunk_manifests(spark, str(tmp_path))
    assert rows(found.select("chunk_index", "end_tick", "uploaded")) == [(0, 5999, False)]
    assert documents.read_session_ledgers(spark, str(tmp_path)).first().ended_at_ms is None
    assert rows(documents.read_ledger_chunks(spark, str(tmp_path)), "chunk_index") == [
        ("s-1", 0, 0, 5999, True), ("s-1", 1, 6000, 6100, False)]
    ticks = spark.createDataFrame([("s-1", 0, 50)], "session_id string, chunk_index int, timestamp_ms long")
    at = chunks.absolute_time(ticks, found).first()
    assert at.at_ms == 1050 and at["at"].year == 1970
    stray = spark.createDataFrame([("s-1", 7, 50), ("s-1", None, 60), ("s-2", 0, 70)], ticks.schema)
    assert {(r.timestamp_ms, r.at_ms) for r in chunks.absolute_time(ticks.union(stray), found).collect()} == {
        (50, 1050), (50, None), (60, None), (70, None)}
    assert chunks.without_manifest(ticks.union(stray), found).count() == 3


def test_actions_and_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"forward": true, "delta_yaw": 1.5}\n{}\nnot json\n{"inventory_slot": 4}\n')
    good, bad = documents.read_actions(spark, str(tmp_path))
    assert sorted((r.forward, r.drop, r.inventory_slot, r.delta_yaw) for r in good.collect()) == [
        (False, False, -1, 0.0), (False, False, 4, 0.0), (True, False, -1, 1.5)]
    assert rows(bad) == [("not json",)]


def test_observations_keep_empty_inventories(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text(
        '{"x": 1.0, "tick": 1, "inventory": [{"slot": 2, "id": "minecraft:dirt", "count": 3}]}\n'
        '{"x": 2.0, "tick": 2, "inventory": []}\n')
    items = documents.observation_items(documents.read_observations(spark, str(tmp_path)))
    assert rows(items.select("tick", "slot", "item", "count"), "tick") == [
        (1, 2, "minecraft:dirt", 3), (2, None, None, None)]


def test_foreign_parquet_is_cast(spark):
    inferred = spark.createDataFrame([(1, 2, "x", 3, 4, "s")],
                                     "tick long, event_type long, item_name string, count long, prev_count long, session_id string")
    cast = documents.cast_to(inferred, S.EVENTS)
    assert [cast.schema[f.name].dataType for f in S.EVENTS] == [f.dataType for f in S.EVENTS]
    assert "session_id" in cast.columns


def test_shared_tables_live_in_the_checkpoint_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_folder(spark) == folder
    back = shared.write_shared(spark.range(3), "x")
    assert back.count() == 3 and all(f"{folder}/tickframe/x-" in p for p in back.inputFiles())


class _Session:
    """A session without the shared folder setting."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()


def test_only_a_local_session_may_do_without_the_setting():
    local = _Session("local[2]")
    assert shared.shared_folder(local) == shared.shared_folder(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(_Session("yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(_Session("local-cluster[2,1,1024]"))


def test_shuffle_files_of_a_shared_table_are_removed(spark, tmp_path):
    import glob
    import tempfile
    import time

    from tickframe.sinks.shared import write_shared

    def files():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))

    before, ids = files(), spark.range(1000)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = ids.groupBy((ids["id"] % 10).alias("k")).count()  # held, so that no collected garbage removes its files
    out = write_shared(kept, "counted")
    assert sorted(tuple(r) for r in out.collect()) == [(k, 100) for k in range(10)]
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(setting, None) in (None, "false")


_ODD = ["7", "hot", None, "", "a/b", "x=1", "%41", "é b", "q?*:[]", "tab\there", "{z}", "__HIVE_DEFAULT_PARTITION__"]


def _odd_sessions(spark, rows=4):
    data = [(s, t, float(t) / 3, [t, None], {"a": t}, (t, None), t % 2 == 0, b"\x00\xff", Decimal(t), datetime.date(2024, 1, 1 + t), None)
            for s in _ODD for t in range(rows)]
    plain = spark.createDataFrame(data, "session_id string, tick int, x double, l array<int>, m map<string,int>, st struct<a:int,b:string>, "
                                  "flag boolean, raw binary, d decimal(9,2), day date, note string")
    return plain.withColumns({"small": F.col("tick").cast("smallint"), "at": F.timestamp_seconds("tick"), "ntz": F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")})


def _by_spark(df, path, mode="overwrite"):
    df.write.mode(mode).partitionBy("session_id").parquet(path)


def test_sessions_written_by_tasks_are_those_of_sparks_writer(spark, tmp_path):
    df = _odd_sessions(spark)
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    tables.write_by_session(df, ours)
    _by_spark(df, theirs)
    names = lambda p: sorted(x.name for x in Path(p).iterdir() if x.is_dir())
    assert names(ours) == names(theirs)
    assert (Path(ours) / "_SUCCESS").exists()
    assert not list(Path(ours).glob("session_id=*/.*"))  # as Spark's writer leaves for every file
    assert spark.read.parquet(ours).schema == spark.read.parquet(theirs).schema
    declared = T.StructType([f for f in df.schema if f.name != "session_id"])
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(documents.read_session_table(spark, ours, declared)) == key(documents.read_session_table(spark, theirs, declared))
    tables.write_by_session(df, ours, "append")
    assert spark.read.parquet(ours).count() == 2 * df.count()
    tables.write_by_session(df.where("tick = 0"), ours, "ignore")
    assert spark.read.parquet(ours).count() == 2 * df.count()
    with pytest.raises(AnalysisException):
        tables.write_by_session(df, ours, "error")
    tables.write_by_session(df.where("session_id = 'hot'"), ours)
    assert names(ours) == ["session_id=hot"]


def test_rows_of_a_file_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MAX_ROWS_PER_FILE", 30)
    df = spark.range(100).select(F.lit("a").alias("session_id"), F.col("id").alias("tick"))
    tables.write_by_session(df.coalesce(1), str(tmp_path / "t"))
    files = list((tmp_path / "t" / "session_id=a").glob("*.parquet"))
    assert len(files) >= 4 and max(pq.ParquetFile(f).metadata.num_rows for f in files) <= 30
    assert sorted(r["tick"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(100))


@pytest.mark.parametrize("split", [64 << 20, 500])
def test_many_sessions_are_read_by_tasks(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(session_files, "MANY", 3)
    monkeypatch.setattr(session_files.ranges, "SPLIT_BYTES", split)
    df = _odd_sessions(spark).select("session_id", "tick", "x", "flag", "small", "note", "raw")
    for name, write in (("ours", tables.write_by_session), ("theirs", _by_spark)):
        path = str(tmp_path / name)
        write(df, path)
        for fields in ("tick int, x double, flag boolean, small smallint, note string, raw binary", "X double, none string, TICK int", "none int"):
            declared = T.StructType.fromDDL(fields)
            found = documents.read_session_table(spark, path, declared, whole=True)
            want = spark.read.schema(f"{fields}, session_id string").parquet(path)
            assert "MapInArrow" in found._jdf.queryExecution().toString()
            assert found.columns == want.columns
            assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    (tmp_path / "ours" / "session_id=7" / "deeper=1").mkdir()
    spark.range(1).withColumn("tick", F.lit(1)).write.parquet(str(tmp_path / "ours" / "session_id=7" / "deeper=1" / "k=2"))
    assert session_files.read_by_tasks(spark, str(tmp_path / "ours"), "session_id", T.StructType.fromDDL("tick int, session_id string")) is None
