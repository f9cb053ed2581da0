"""Edges, inventory, chunks, agents and quality operators on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickframe.functions import angles, labels, scores, text
from tickframe.operators import (admission, agents, chunks, edges, inventory, ordinals, packets,
                                 quality, segments)


def test_angle_deltas_restart_with_each_chunk(spark):
    ticks = spark.createDataFrame([("s", t, y, p) for t, y, p in
                                   [(0, 170.0, 0.0), (1, -170.0, 5.0), (2, 10.0, 5.0), (3, 190.0, 1.0)]],
                                  "session_id string, tick int, player_yaw double, player_pitch double")
    chunked = edges.add_chunk(ticks, 2)
    assert [r.chunk_index for r in chunked.orderBy("tick").collect()] == [0, 0, 1, 1]
    assert rows(edges.angle_deltas(chunked).select("yaw_delta", "pitch_delta"), "tick") == [
        (0.0, 0.0), (20.0, 5.0), (0.0, 0.0), (180.0, -4.0)]
    whole = edges.angle_deltas(ticks, ["session_id"], width=2)
    assert rows(whole.select("yaw_delta"), "tick") == [(0.0,), (20.0,), (180.0,), (180.0,)]


def test_wrap_keeps_both_ends(spark):
    def loop(d):
        while d > 180:
            d -= 360
        while d < -180:
            d += 360
        return d

    values = [0.0, 180.0, -180.0, 180.5, -180.5, 540.0, -540.0, 539.0, 900.0, -900.0, 359.0, 1e4]
    got = spark.createDataFrame([(v,) for v in values], "d double").select(
        angles.wrap_degrees(F.col("d"))).collect()
    assert [r[0] for r in got] == [loop(v) for v in values]


def states(spark, name, kind, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)],
                                 f"session_id string, tick int, {name} {kind}")


@pytest.mark.parametrize("width", [None, 2])
def test_edges_and_their_initial_states(spark, width):
    alive = states(spark, "alive", "boolean", [False, False, True, False, True])
    assert [r.tick for r in edges.death_edges(alive, width=width).orderBy("tick").collect()] == [0, 3]
    sleeping = states(spark, "sleeping", "boolean", [True, True, False, True])
    assert [r.tick for r in edges.sleep_onsets(sleeping, width=width).orderBy("tick").collect()] == [0, 3]
    # The first known dimension is no change; a missing one changes nothing.
    seen = states(spark, "dimension", "string", [None, "n", None, "n", "o", None, "n"])
    assert rows(edges.dimension_changes(seen, width=width).select("tick", "dimension"), "tick") == [
        (4, "o"), (6, "n")]


@pytest.mark.parametrize("width", [None, 2])
def test_equipment_compares_whole_stacks(spark, width):
    stacks = spark.createDataFrame(
        [("s", "MAINHAND", 0, None, None, None), ("s", "MAINHAND", 1, "sword", False, 1),
         ("s", "MAINHAND", 2, "sword", False, 1), ("s", "MAINHAND", 3, "sword", True, 1),
         ("s", "MAINHAND", 4, "sword", True, 2), ("s", "MAINHAND", 5, None, None, None), ("s", "HEAD", 3, "cap", None, 1)],
        "session_id string, slot string, tick int, item string, enchanted boolean, count int")
    assert rows(edges.equipment_changes(stacks, width=width).select("tick", "equipment"), "tick", "equipment") == [
        (1, "mainhand:sword"), (3, "head:cap"), (3, "mainhand:sword:ench"), (4, "mainhand:sword:ench"),
        (5, "mainhand:empty")]


def test_equipment_text_parses_back(spark):
    parsed = spark.createDataFrame([("head:cap:ench",), ("feet:empty",)], "t string").select(
        text.parse_equipment(F.col("t")).alias("p")).select("p.*")
    assert rows(parsed) == [("head", "cap", True), ("feet", "empty", False)]


def test_boss_health(spark):
    bars = spark.createDataFrame(
        [("s", 0, 1.0, "Ender Dragon"), ("s", 1, 1.0, "ender dragon"), ("s", 2, 0.5, "Wither"),
         ("s", 3, 0.755, "THE ENDER DRAGON"), ("s", 4, 250.0, "Ender Dragon")],
        "session_id string, tick int, percent double, bar_name string")
    assert rows(edges.boss_health_changes(bars).select("tick", "health_fixed"), "tick") == [
        (0, 100), (3, 75), (4, 10000)]


def test_unwrapped_yaw_passes_the_overflow(spark):
    ticks = states(spark, "yaw_fp", "int", [32000, -32000, -31000, 32500])
    got = [r.yaw_unwrapped for r in edges.unwrap_yaw(ticks, width=2).orderBy("tick").collect()]
    assert got == [320.0, 335.36, 345.36, 325.0]


def test_item_deltas(spark):
    slots = spark.createDataFrame(
        [("s", 0, 0, "oak", 2), ("s", 0, 1, "oak", 3), ("s", 1, 0, "oak", 5), ("s", 2, 0, "dirt", 1), ("s", 0, 2, "air", 0)],
        "session_id string, tick long, slot int, item string, count int")
    ticks = spark.range(4).select(F.lit("s").alias("session_id"), F.col("id").alias("tick"))
    totals = inventory.item_totals(slots)
    assert rows(totals, "tick", "item") == [("s", 0, "oak", 5), ("s", 1, "oak", 5), ("s", 2, "dirt", 1)]
    columns = ["tick", "item", "count", "prev_count"]
    plain = inventory.item_deltas(totals, ticks)
    assert rows(plain.select(*columns), "tick", "item") == [
        (0, "oak", 5, 0), (2, "dirt", 1, 0), (2, "oak", 0, 5), (3, "dirt", 0, 1)]
    # Per chunk of one tick every held item is a gain again, and losses go unseen.
    chunked = inventory.item_deltas(totals, ticks, reset_every=1)
    assert rows(chunked.select(*columns), "tick", "item") == [
        (0, "oak", 5, 0), (1, "oak", 5, 0), (2, "dirt", 1, 0)]
    assert rows(inventory.repair_deltas(chunked).select(*columns), "tick", "item") == [
        (0, "oak", 5, 0), (2, "dirt", 1, 0)]


def test_nothing_follows_the_last_tick(spark):
    totals = spark.createDataFrame([("s", 0, "oak", 5)], "session_id string, tick long, item string, count long")
    ticks = spark.createDataFrame([("s", 0)], "session_id string, tick long")
    assert inventory.item_deltas(totals, ticks).count() == 1


def test_lookup_takes_the_first_chunk(spark):
    index = spark.createDataFrame(
        [("s", "a", 0, 9), ("s", "b", 8, 20), ("s", "c", 8, 20), ("s", "d", 30, 40), ("t", "e", 0, 5)],
        "session_id string, path string, start_tick long, end_tick long")
    points = spark.createDataFrame([("s", t) for t in (0, 8, 9, 10, 20, 25, 30, 41)], "session_id string, tick long")
    for bin_ticks in (4, 4096):
        got = chunks.lookup_chunk(points, index, bin_ticks)
        assert rows(got.select("tick", "path", "offset_in_chunk"), "tick") == [
            (0, "a", 0), (8, "a", 8), (9, "a", 9), (10, "b", 2), (20, "b", 12), (30, "d", 0)]


@pytest.mark.parametrize("width", [None, 7, 100])
def test_overlapping_chunks_are_cut_apart(spark, width):
    rng = random.Random(2)
    ranges = [(rng.choice("ab"), f"{rng.randint(0, 30):02}.cap", s, s + rng.choice([0, 3, 40, 400]))
              for s in [rng.randint(0, 300) for _ in range(3000)]]
    index = spark.createDataFrame(ranges, "session_id string, path string, start_tick long, end_tick long")
    owner = {}
    for session, path, start, end in sorted(ranges, key=lambda r: (r[2], r[1])):
        for t in range(start, end + 1):
            owner.setdefault((session, t), (path, start))
    cut = {}
    for r in chunks.disjoint_chunks(index, width=width).collect():
        for t in range(r.first_tick, r.end_tick + 1):
            assert (r.session_id, t) not in cut
            cut[r.session_id, t] = (r.path, r.start_tick)
    assert cut == owner
    points = spark.createDataFrame([(s, t, t % 5) for s in "abc" for t in range(-3, 760, 2)] * 2, "session_id string, tick long, v long")
    got = chunks.lookup_chunk(points, index, width).collect()
    assert len(got) == 2 * sum((s, t) in owner for s in "abc" for t in range(-3, 760, 2))
    assert all(owner[r.session_id, r.tick] == (r.path, r.start_tick) and r.offset_in_chunk == r.tick - r.start_tick and r.v == r.tick % 5 for r in got)


def test_positional_chunks_start_at_the_first_row(spark):
    ticks = spark.createDataFrame([("s", t) for t in (7, 8, 20, 21, 22)], "session_id string, tick long")
    for width in (None, 2):
        placed = chunks.positional_chunks(ticks, 2, width=width)
        assert [r.chunk_no for r in placed.orderBy("tick").collect()] == [0, 0, 1, 1, 2]


def test_hold_last_and_lock_step(spark):
    ticks = spark.createDataFrame([("c", a) for a in (0, 10, 20, 30)] + [("d", 10)], "connection_id string, at long")
    actions = spark.createDataFrame([("c", 4, "x"), ("c", 6, "y"), ("c", 10, "z"), ("c", 25, "w")],
                                    "connection_id string, at long, key string")
    for width in (None, 5):
        held = agents.hold_last(ticks, actions, ["key"], width=width)
        assert rows(held.select("connection_id", "at", "key"), "connection_id", "at") == [
            ("c", 0, None), ("c", 10, "z"), ("c", 20, "z"), ("c", 30, "w"), ("d", 10, None)]
        stepped = agents.hold_last(ticks, actions, ["key"], lock_step=True, width=width)
        assert rows(stepped.select("at", "key"), "at") == [(10, "z"), (30, "w")]


@pytest.mark.parametrize("width", [None, 3])
def test_pitch_is_held_at_every_step(spark, width):
    rng = random.Random(3)
    steps = [(s, t, rng.uniform(-80, 80)) for s in ("a", "b") for t in range(40)]
    actions = spark.createDataFrame(steps, "session_id string, tick int, delta_pitch double")
    got = agents.camera_pitch(actions, start_pitch=5.0, width=width).orderBy("session_id", "tick").collect()
    pitch = {"a": 5.0, "b": 5.0}
    for r in got:
        pitch[r.session_id] = max(-90.0, min(90.0, pitch[r.session_id] + r.delta_pitch))
        assert r.pitch == pytest.approx(pitch[r.session_id], abs=1e-9)
    assert len(got) == 80


def test_held_slot_ignores_bad_requests(spark):
    asked = states(spark, "inventory_slot", "int", [-1, 3, 9, -1, 8, 100])
    got = [r.selected_slot for r in edges.held_slot(asked, width=2).orderBy("tick").collect()]
    assert got == [None, 3, 3, 3, 8, 8]


def test_admission(spark):
    verdicts = spark.createDataFrame(
        [("a", 0, "DENY_TRANSIENT"), ("a", 1, "ALLOW"), ("a", 2, "DENY_PERMANENT"),
         ("b", 0, "DENY_PERMANENT"), ("b", 1, "ALLOW"), ("c", 0, "DENY_TRANSIENT")],
        "session_id string, tick int, verdict string")
    assert rows(admission.session_starts(verdicts), "session_id") == [
        ("a", 1, "ALLOW"), ("b", 0, "DENY_PERMANENT"), ("c", None, None)]
    assert rows(admission.admitted_ticks(verdicts).select("session_id", "tick"), "tick") == [("a", 1), ("a", 2)]


def test_ledger_checks(spark):
    ledger = spark.createDataFrame([("s", 0, 0, 5999), ("s", 1, 6000, 11999), ("s", 2, 12001, 12500)],
                                   "session_id string, chunk_index int, start_tick int, end_tick int")
    assert rows(quality.ledger_gaps(ledger).select("chunk_index", "gap")) == [(2, 1)]
    fixed = quality.normalise_ends(ledger)
    assert rows(fixed.select("end_tick"), "chunk_index") == [(5999,), (11999,), (12499,)]
    running = spark.createDataFrame([("t",)], "session_id string")
    assert rows(quality.normalise_ends(ledger, ended=running).select("end_tick"), "chunk_index")[2] == (12500,)


def test_upload_checks(spark):
    key = "session_id string, chunk_index int"
    known = spark.createDataFrame([("s", 0), ("s", 1)], key)
    names = ["tick_stream.parquet", "events.parquet", "manifest.json"]
    present = spark.createDataFrame([("s", 0, n) for n in names] + [("s", 1, names[0]), ("s", 1, "x")],
                                    key + ", file string")
    assert rows(quality.missing_files(known, present).select("file"), "file") == [
        ("events.parquet",), ("manifest.json",)]
    assert rows(quality.ready_chunks(known, present)) == [("s", 0)]


def test_position_report(spark):
    schema = "session_id string, tick int, x double, y double, z double"
    recorded = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 1, 0.0, 0.0, 0.0)], schema)
    predicted = spark.createDataFrame([("s", 0, 3.0, 4.0, 0.0), ("s", 1, 0.0, 0.0, 7.0)], schema)
    report = quality.error_report(quality.position_errors(predicted, recorded)).first()
    assert (report.ticks, report.avg_error, report.alert) == (2, 6.0, True)


def test_unknown_entities_drop_out(spark):
    statuses = spark.createDataFrame([("s", 1, 3), ("s", 2, 3), ("s", 1, 2)],
                                     "session_id string, entity_id int, status int")
    entities = spark.createDataFrame([("s", 1, "minecraft:blaze")],
                                     "session_id string, entity_id int, entity_type string")
    assert rows(quality.entity_kills(statuses, entities).select("entity_id", "entity_type")) == [
        (1, "minecraft:blaze")]


def test_packet_names_and_preview(spark):
    ids = spark.createDataFrame([(1,), (8,), (99,)], "packet_id int")
    assert [r[0] for r in ids.select(labels.packet_name(F.col("packet_id"))).collect()] == [
        "ScreenHandlerSlotUpdate", "HeldItemChange", "Unknown"]
    data = spark.createDataFrame([(b"\x0a" * 32,), (b"\x0a" * 33,)], "d binary")
    assert [r[0] for r in data.select(text.payload_preview(F.col("d"))).collect()] == [
        "0a" * 32, "0a" * 32 + "..."]
    counts = packets.type_counts(spark.createDataFrame([(2,), (3,), (3,)], "packet_id int"))
    assert [tuple(r) for r in counts.collect()] == [(3, "OpenScreen", 2), (2, "Inventory", 1)]


def test_nether_score_truncates(spark):
    ticks = spark.createDataFrame([(0,), (500,), (2880,), (3023,), (3024,), (10**6,)], "n long")
    assert [r[0] for r in ticks.select(scores.nether_score(F.col("n"))).collect()] == [-1, 100, 100, 100, 99, 0]


@pytest.mark.parametrize("keys", [1, 7, 300])
def test_ordinals_under_skew(spark, keys):
    """Key 0 holds two thirds of the rows; times repeat; partitions cut keys anywhere."""
    data = (spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % keys).cast("string").alias("session_id"),
        (F.col("id") * 7919 % 50).alias("ts"), F.col("id").alias("event_id")).repartition(5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = ordinals.number_rows(data, ["session_id"], ["ts", "event_id"], "ord")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = numbered.orderBy("session_id", "ord").collect()
    assert len(got) == 3000
    want, last = [], None
    for s, ts, e in sorted((r.session_id, r.ts, r.event_id) for r in got):
        n = 0 if s != last else n + 1
        last = s
        want.append((s, ts, e, n))
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_segmented_windows_equal_plain_ones(spark, width):
    rng = random.Random(width)
    data = [(k, t, rng.choice([None, 1, 2, 3])) for k in "ab" for t in sorted(rng.sample(range(100), 30))]
    df = spark.createDataFrame(data, "k string, t long, v int")
    by = lambda d: [r[-1] for r in d.orderBy("k", "t").collect()]
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    assert by(segments.as_of(df, ["k"], "t", {"x": F.col("v")}, width)) == by(
        df.withColumn("x", F.last("v", True).over(upto)))
    assert by(segments.as_of(df, ["k"], "t", {"x": F.col("v")}, width, include_current=False)) == by(
        df.withColumn("x", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    assert by(segments.running_total(df, ["k"], "t", {"x": F.coalesce("v", F.lit(0))}, width)) == by(
        df.withColumn("x", F.sum(F.coalesce("v", F.lit(0))).over(upto)))
    assert by(segments.position(df, ["k"], "t", "x", width)) == by(
        df.withColumn("x", F.row_number().over(w) - 1))
    lagged = segments.previous(df, ["k"], "t", {"x": F.col("v")}, width)
    assert by(lagged.withColumn("y", F.col("x.value"))) == by(df.withColumn("x", F.lag("v").over(w)))
    assert lagged.where("x IS NULL").count() == 2
