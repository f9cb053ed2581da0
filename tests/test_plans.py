"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tickframe.operators import agents, chunks, ordinals, packets, runs
from tickframe.plans import QUERIES, workload
from tickframe.schemas import TRACKER
from tickframe.sources import sizing


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_summary"}))
def test_no_cross_product_and_no_unpartitioned_window(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text or name in ("max_tick",), "everything in one task"


def test_summary_shuffles_the_stream_once(spark):
    stream = spark.createDataFrame([], TRACKER)
    text = plan(runs.run_summary(stream))
    exchanges = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    # The calls by (session, segment), then one row per segment by session.
    assert len(exchanges) == 2 and "_segment" in exchanges[1] and "_segment" not in exchanges[0].split("ENSURE")[0]


def test_preview_limits_rows_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    text = plan(chunks.preview(rows, ["k"], "id", 3))
    assert text.count("WindowGroupLimit") == 2


def test_payloads_are_not_read_for_packet_lists(spark, tmp_path):
    spark.sql("SELECT 's' session_id, 1L tick, 0L pos, 5 packet_id, 3L data_len, 7L timestamp_ms, X'00' data"
              ).write.parquet(str(tmp_path / "p"))
    text = plan(packets.packet_lists(spark.read.parquet(str(tmp_path / "p"))))
    assert "ReadSchema: struct<" in text and "data:binary" not in text


def test_telemetry_queries_read_only_their_columns(spark):
    sleep = plan(QUERIES["sleep_onsets"](spark, SMALL))
    assert all("value:double" not in line for line in sleep.split("\n") if "ReadSchema" in line)
    changes = plan(QUERIES["dimension_changes"](spark, SMALL))
    assert "EqualTo(event_type,signup)" in changes
    assert all("value:double" not in line for line in changes.split("\n") if "ReadSchema" in line)


def test_only_the_carry_of_the_numbering_is_broadcast_by_hint(spark):
    tele = workload.telemetry(spark, SMALL)
    text = tele._jdf.queryExecution().analyzed().toString()
    assert text.count("strategy=broadcast") == 1


def test_partition_number_follows_the_input(spark):
    assert sizing.partitions_for(10, 200) == 200
    assert sizing.partitions_for(100 << 40, 200) == 819_200
    assert sizing.partitions_for(1 << 40, 200) == 8192
    assert sizing.input_bytes(spark, SMALL) > 100_000


@pytest.mark.parametrize("batch_rows", [1, 7])
def test_python_scans_carry_state_across_batches(spark, batch_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        steps = spark.range(60).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("tick"),
                                       ((F.col("id") * 37) % 101 - 50).cast("double").alias("delta_pitch"))
        got = agents.camera_pitch(steps, width=20).orderBy("session_id", "tick").collect()
        pitch = {}
        for r in got:
            pitch[r.session_id] = max(-90.0, min(90.0, pitch.get(r.session_id, 0.0) + r.delta_pitch))
            assert r.pitch == pitch[r.session_id]
        numbered = ordinals.number_rows(steps, ["session_id"], ["tick"], "ord").orderBy("session_id", "tick").collect()
        assert [r.ord for r in numbered] == list(range(20)) * 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
