"""Streaming summaries: parity with batch, order of arrival, replays, timeouts, late rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_runs import random_session
from tickframe import schemas as S
from tickframe.operators import runs
from tickframe.streaming import sessions as streaming
from tickframe.streaming.assembly import complete_chunks, window_counts
from tickframe.streaming.runtime import stateful_session

CHUNK_TICKS = 5
START = dt.datetime(2024, 1, 1)


def as_rows(calls, chunk, ended):
    """Landed rows of one closed chunk."""
    out = [(*c, chunk, START + dt.timedelta(seconds=max(c[2], 0)), 1000 * chunk + k) for k, c in enumerate(calls)]
    if ended:
        out.append((calls[0][0], calls[0][1], calls[-1][2], 7, "END", None, None, chunk, out[-1][-2], 1000 * chunk + 999))
    return [(*r, len(out)) for r in out]


def land_rows(spark, folder, rows):
    spark.createDataFrame(rows, streaming.STREAM).coalesce(1).write.mode("append").parquet(str(folder))


def land(spark, folder, calls, chunk, ended):
    """One file per closed chunk."""
    land_rows(spark, folder, as_rows(calls, chunk, ended))


def by_chunk(calls):
    groups = {}
    for c in calls:
        groups.setdefault(max(c[2], 0) // CHUNK_TICKS, []).append(c)
    return groups


def gather(spark, landing, work, files_per_batch=1, **options):
    streaming.write_partials(
        streaming.read_closed_chunks(stateful_session(spark), str(landing), files_per_batch), str(work / "partials"),
        str(work / "c1"), str(work / "rejected"), availableNow=True, **options).awaitTermination()


def summarise(spark, work, checkpoint="c2", **options):
    told = F.lit("call").alias("outcome")
    shape = streaming.chunk_partials(spark.createDataFrame([], streaming.STREAM).select("*", told)).schema
    totals = streaming.summarise_sessions(streaming.read_partials(stateful_session(spark), str(work / "partials"), shape), **options)
    streaming.write_runs(totals, str(work / "runs"), str(work / checkpoint), availableNow=True).awaitTermination()
    return streaming.read_runs(spark, str(work / "runs"))


def totals_of(spark, landing, work, files_per_batch=1, **options):
    gather(spark, landing, work, files_per_batch)
    return summarise(spark, work, **options)


def test_out_of_order_chunks_give_the_batch_summary(spark, tmp_path):
    rng = random.Random(2)
    sessions = {f"s{i}": random_session(rng, f"s{i}") for i in range(3)}
    pieces = [(calls, n, n == max(by_chunk(all_calls)))
              for all_calls in sessions.values() for n, calls in by_chunk(all_calls).items()]
    rng.shuffle(pieces)
    for calls, n, ended in pieces[:8]:
        land(spark, tmp_path / "in", calls, n, ended)
    # What has not arrived yet keeps its session open; a second run picks up where the first ended.
    first = totals_of(spark, tmp_path / "in", tmp_path, files_per_batch=3).count()
    for calls, n, ended in pieces[8:]:
        land(spark, tmp_path / "in", calls, n, ended)
    land(spark, tmp_path / "in", *pieces[0])  # a chunk delivered twice
    got = totals_of(spark, tmp_path / "in", tmp_path, files_per_batch=3)
    assert first <= got.count() == len(sessions)
    stream = spark.createDataFrame([c for calls in sessions.values() for c in calls], S.TRACKER)
    want = {r.session_id: r for r in runs.run_summary(stream).collect()}
    for r in runs.finish_summary(got).collect():
        assert r == want[r.session_id]


def test_a_silent_session_is_told_after_the_gap(spark, tmp_path):
    """Its second chunk never comes: what is known of it is told, and marked."""
    quiet = random_session(random.Random(4), "quiet")
    chunks = by_chunk(quiet)
    for n, calls in chunks.items():
        if n != 1:
            land(spark, tmp_path / "in", calls, n, n == max(chunks))
    options = {"gap_ms": 1, "slack": "0 seconds"}
    assert totals_of(spark, tmp_path / "in", tmp_path, 100, **options).count() == 0
    land(spark, tmp_path / "in", [("later", "p", 0, 0, "TICK", None, None)], 0, True)
    found = {r.session_id: r for r in totals_of(spark, tmp_path / "in", tmp_path, 100, **options).collect()}
    heard = [c for n, calls in chunks.items() if n != 1 for c in calls]
    want = runs.run_summary(spark.createDataFrame(heard, S.TRACKER)).first()
    assert (found["quiet"].complete, found["quiet"].missing_chunks, found["quiet"].chunks) == (False, 1, len(chunks) - 1)
    assert found["quiet"].duration_ticks == want.duration_ticks and found["quiet"].gold_traded == want.gold_traded
    assert found["later"].complete


def test_a_chunk_in_two_files_and_a_replay_after_the_end(spark, tmp_path):
    calls = random_session(random.Random(12), "s")
    chunks = by_chunk(calls)
    landed = {n: as_rows(own, n, n == max(chunks)) for n, own in chunks.items()}
    for n, rows in landed.items():  # odd calls first, in a batch of their own
        if rows[1::2]:
            land_rows(spark, tmp_path / "in", rows[1::2])
    gather(spark, tmp_path / "in", tmp_path)
    assert summarise(spark, tmp_path).count() == 0
    for rows in landed.values():
        land_rows(spark, tmp_path / "in", rows[::2])
    assert totals_of(spark, tmp_path / "in", tmp_path).count() == 1
    land_rows(spark, tmp_path / "in", landed[0])
    land_rows(spark, tmp_path / "in", landed[max(chunks)][-1:])
    got = totals_of(spark, tmp_path / "in", tmp_path)
    assert runs.finish_summary(got).collect() == runs.run_summary(spark.createDataFrame(calls, S.TRACKER)).collect()
    assert got.first().complete
    rejected = spark.read.parquet(str(tmp_path / "rejected"))
    assert rejected.count() == len(landed[0]) + 1 and {r.outcome for r in rejected.collect()} == {"repeated"}


def test_a_chunk_that_stays_open_goes_on_as_it_is(spark, tmp_path):
    rows = as_rows([("s", "p", t, 0, "TICK", None, None) for t in range(4)], 0, True)
    land_rows(spark, tmp_path / "in", rows[1:])
    gather(spark, tmp_path / "in", tmp_path, gap_ms=1, slack="0 seconds")
    land(spark, tmp_path / "in", [("t", "p", 0, 0, "TICK", None, None)], 0, True)
    gather(spark, tmp_path / "in", tmp_path, gap_ms=1, slack="0 seconds")
    found = {r.session_id: r for r in summarise(spark, tmp_path).collect()}
    assert (found["s"].duration_ticks, found["s"].complete) == (3, False)
    assert (found["t"].duration_ticks, found["t"].complete) == (1, True)


def test_another_checkpoint_replaces_runs_and_nothing_else(spark, tmp_path):
    for name in ("a", "b", "c"):
        land(spark, tmp_path / "in", [(name, "p", t, 0, "TICK", None, None) for t in range(3)], 0, True)
    gather(spark, tmp_path / "in", tmp_path)
    first = sorted(summarise(spark, tmp_path).collect())
    land(spark, tmp_path / "in", [("d", "p", 0, 0, "TICK", None, None)], 0, True)
    gather(spark, tmp_path / "in", tmp_path)
    assert summarise(spark, tmp_path).count() == 4
    # A checkpoint that starts anew counts its batches from 0 and tells all runs again.
    again = sorted(summarise(spark, tmp_path, "c3").collect())
    assert [r for r in again if r.session_id != "d"] == first and len(again) == 4


def test_the_callers_session_keeps_its_settings(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    beside = stateful_session(spark, 3)
    assert "RocksDB" in beside.conf.get(key) and beside.conf.get("spark.sql.shuffle.partitions") == "3"
    assert beside.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_late_rows_are_told(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    shape = "session_id string, ts timestamp, call_no long, ended boolean"
    batches = [[("s", at(0), 1, False), ("s", at(30), 2, False), ("t", at(0), 1, False)],
               [("s", at(1), 3, False), ("s", at(25), 4, False), ("s", None, 5, False), ("t", at(1), 2, False)],
               [("s", None, 6, True), ("t", None, 3, True)]]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        landed = stateful_session(spark).readStream.schema(shape).parquet(str(tmp_path / "in"))
        counted = window_counts(landed, "5 minutes", "10 minutes")
        streaming.write_totals(counted, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True).awaitTermination()
    out = streaming.read_totals(spark, str(tmp_path / "out"), counted.schema).collect()
    assert {(r.session_id, r.call_no) for r in out if r.what == "late"} == {("s", 3), ("s", 5), ("s", 6), ("t", 3)}
    windows = {}
    for r in out:
        if r.what == "window":
            windows[r.session_id, r.window_start] = windows.get((r.session_id, r.window_start), 0) + r.rows
    assert windows == {("s", at(0)): 1, ("s", at(30)): 1, ("s", at(25)): 1, ("t", at(0)): 2}
    assert sum(r.rows for r in out) == sum(map(len, batches))


@pytest.mark.parametrize("records", [10_000, 3])
def test_many_chunks_share_a_call_of_state(spark, tmp_path, records):
    """A timer for each bucket instead of one for each chunk, whatever cuts the rows of a bucket into frames."""
    names = [f"s{i}" for i in range(20)] + [None]
    first = [(n, "p", t, 0, "TICK", None, None if t else 5, c, START, 10 * c + t, 4) for n in names for c in (0, 1) for t in range(2)]
    rest = [(n, "p", t, 0, "TICK", None, None, c, START, 10 * c + t, 4) for n in names for c in (0, 1) for t in range(1, 4 - c)]
    timers = 0
    for rows in (first, rest):
        land_rows(spark, tmp_path / "in", rows)
        session = stateful_session(spark, 2)
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        stream = complete_chunks(streaming.read_closed_chunks(session, str(tmp_path / "in")), ["session_id", streaming.CHUNK], buckets=3)
        q = streaming.write_totals(stream, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True)
        q.awaitTermination()
        timers += sum(p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in q.recentProgress)
    out = streaming.read_totals(spark, str(tmp_path / "out"), stream.schema).collect()
    told = {n: sorted((r.chunk_index, r.tick, r.delta) for r in out if r.session_id == n and r.outcome == "call") for n in names}
    assert all(t == [(0, 0, 5), (0, 1, None), (0, 2, None), (0, 3, None)] for t in told.values())
    again = [(r.chunk_index, r.tick) for r in out if r.outcome == "repeated"]
    assert sorted(again) == sorted((c, 1) for c in (0, 1) for _ in names)
    assert 0 < timers <= 3


def test_many_sessions_share_a_call_of_state(spark, tmp_path):
    rng = random.Random(5)
    sessions = {f"s{i}": random_session(rng, f"s{i}") for i in range(12)}
    told = F.lit("call").alias("outcome")
    shape = streaming.chunk_partials(spark.createDataFrame([], streaming.STREAM).select("*", told)).schema
    calls = [r for own in sessions.values() for n, c in by_chunk(own).items() for r in as_rows(c, n, n == max(by_chunk(own)))]
    parts = streaming.chunk_partials(spark.createDataFrame(calls, streaming.STREAM).select("*", told))
    path, timers = str(tmp_path / "partials"), 0
    for half in (1, 0):  # the later chunk of two comes first
        parts.where(F.col("_segment") % 2 == half).coalesce(1).write.parquet(f"{path}/source=a/batch={half}")
        totals = streaming.summarise_sessions(streaming.read_partials(stateful_session(spark, 2), path, shape), buckets=3)
        q = streaming.write_runs(totals, str(tmp_path / "runs"), str(tmp_path / "c"), availableNow=True)
        q.awaitTermination()
        timers += sum(p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in q.recentProgress)
    got = runs.finish_summary(streaming.read_runs(spark, str(tmp_path / "runs"))).collect()
    want = runs.run_summary(spark.createDataFrame([c for own in sessions.values() for c in own], S.TRACKER)).collect()
    assert sorted(got) == sorted(want) and len(got) == 12
    assert 0 < timers <= 6


def test_sessions_share_a_call_that_counts_windows(spark, tmp_path):
    """One entry of state for a session, not one for each of its windows besides."""
    shape = "session_id string, ts timestamp, call_no long, ended boolean"
    names = [f"s{i}" for i in range(6)] + [None]
    rows = [(n, START + dt.timedelta(hours=h), h, False) for n in names for h in range(4)]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    landed = stateful_session(spark, 2).readStream.schema(shape).parquet(str(tmp_path / "in"))
    counted = window_counts(landed, "1 hour", "1 day", buckets=2)
    q = streaming.write_totals(counted, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True)
    q.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) == len(names)
    assert streaming.read_totals(spark, str(tmp_path / "out"), counted.schema).count() == 0


def test_duplicates_within_the_watermark_go_away(spark, tmp_path):
    row = ("s", "p", 3, 0, "TICK", None, None)
    later = ("s", "p", 4, 0, "TICK", None, None)
    for calls in ([(row, 0, 3), (row, 0, 3)], [(row, 0, 3), (later, 1, 4)]):  # a call delivered three times, and another
        land_rows(spark, tmp_path / "in", [(*c, 0, START + dt.timedelta(seconds=at), number, 2) for c, number, at in calls])
    equal = [(*row, 0, START, 7, 2), (*row, 0, START, 8, 2)]  # two equal calls of one tick
    spark.createDataFrame(equal, streaming.STREAM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.drop_duplicates(streaming.read_closed_chunks(spark, str(tmp_path / "in")), "1 hour")
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.tick for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 3, 3, 4]


def test_tumbling_windows(spark, tmp_path):
    land(spark, tmp_path / "in", [("s", "p", t, 0, "TICK", None, None) for t in (0, 299, 300, 5000)], 0, False)
    windows = streaming.chunk_windows(streaming.read_closed_chunks(spark, str(tmp_path / "in")), "0 seconds")
    q = (windows.writeStream.outputMode("complete").format("memory").queryName("windows")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    counts = {r.window_start: r.rows for r in spark.table("windows").collect()}
    assert counts[START] == 2 and sum(counts.values()) == 4


@pytest.mark.parametrize("by", ["chunk_index", None])
def test_partials_merge_by_chunk_or_segment(spark, by):
    calls = random_session(random.Random(11), "s")
    stream = spark.createDataFrame(calls, S.TRACKER).withColumn(
        "chunk_index", F.floor(F.greatest("tick", F.lit(0)) / CHUNK_TICKS).cast("int"))
    got = runs.finish_summary(runs.fold_partials(runs.segment_partials(stream, by=by, width=3))).first()
    assert got == runs.run_summary(stream.drop("chunk_index")).first()
