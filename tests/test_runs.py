"""Run summaries: the known cases, the order of calls within a tick, and a scalar fold as oracle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickframe import schemas as S
from tickframe.operators import runs

NETHER, END, OVER = "minecraft:the_nether", "minecraft:the_end", "minecraft:overworld"


class Calls:
    """Collects tracker calls of one session the way a recorder would make them."""

    def __init__(self, session):
        self.session, self.rows, self.count, self.rank = session, [], 0, 0

    def ticks(self, n):
        for _ in range(n):
            self.rows.append((self.session, f"p-{self.session}", self.count, 0, "TICK", None, None))
            self.count += 1
        self.rank = 0
        return self

    def call(self, kind, name=None, delta=None):
        self.rank += 1
        self.rows.append((self.session, f"p-{self.session}", self.count - 1, self.rank, kind, name, delta))
        return self


def summary(spark, calls, **options):
    stream = spark.createDataFrame(calls.rows, S.TRACKER)
    return runs.run_summary(stream, **options).first()


def win():
    """Conformance case: ticks, resources and scores are fixed values."""
    return (Calls("win").ticks(3600).call("DIMENSION", NETHER).ticks(3720)
            .call("INVENTORY", "minecraft:blaze_rod", -7).call("INVENTORY", "minecraft:ender_pearl", -12)
            .call("DIMENSION", END).ticks(400).call("PLACED", "minecraft:white_bed")
            .call("KILLED", "minecraft:ender_dragon"))


@pytest.mark.parametrize("width", [None, 1000])
def test_win(spark, width):
    r = summary(spark, win(), width=width)
    assert (r.outcome, r.completed, r.category, r.seed_quality) == ("win", True, "any_percent", -1)
    assert (r.duration_ticks, r.overworld_ticks, r.nether_ticks, r.end_ticks) == (7720, 3600, 3720, 400)
    assert (r.blaze_rods_used, r.pearls_used, r.beds_used) == (7, 12, 1)
    assert (r.portal_build_tick, r.dragon_enter_tick, r.kill_tick) == (3600, 7320, 7720)
    assert (r.efficiency_score, r.nether_score, r.stronghold_enter_tick) == (100, 95, -1)
    assert len(r.run_id) == 36 and r.run_id.count("-") == 4
    assert (r.session_id, r.player_id) == ("win", "p-win")


def test_quit(spark):
    calls = Calls("quit").ticks(37).call("DIMENSION", NETHER).ticks(11).call("DIMENSION", OVER).ticks(2).call("DIMENSION", NETHER).ticks(1)
    r = summary(spark, calls, width=10)
    assert (r.outcome, r.completed, r.nether_ticks, r.overworld_ticks, r.end_ticks) == ("quit", False, 12, 39, 0)
    assert (r.kill_tick, r.dragon_enter_tick, r.portal_build_tick, r.duration_ticks) == (-1, -1, 37, 51)


def test_death(spark):
    r = summary(spark, Calls("dead").ticks(2000).call("DIED").call("DIED"))
    assert (r.outcome, r.deaths, r.efficiency_score, r.nether_score) == ("death", 2, 80, -1)


def test_win_beats_death(spark):
    r = summary(spark, Calls("both").ticks(5).call("DIED").ticks(5).call("KILLED", "minecraft:ender_dragon"))
    assert (r.outcome, r.deaths) == ("win", 1)


def test_score_floor(spark):
    r = summary(spark, Calls("floor").call("INVENTORY", "minecraft:blaze_rod", -20)
                .call("INVENTORY", "minecraft:ender_pearl", -30))
    assert r.efficiency_score == 0


def test_beds_count_only_in_the_end(spark):
    r = summary(spark, Calls("beds").call("PLACED", "minecraft:white_bed").call("DIMENSION", END)
                .call("PLACED", "minecraft:white_bed").call("PLACED", "minecraft:stone"))
    assert (r.beds_used, r.dragon_enter_tick) == (1, 0)


def test_counters(spark):
    calls = (Calls("count").ticks(1).call("DIMENSION", NETHER)
             .call("INVENTORY", "minecraft:blaze_rod", 9).call("INVENTORY", "minecraft:blaze_rod", -7)
             .call("INVENTORY", "minecraft:gold_ingot", -5).call("TRADE", None, 18)
             .call("DIMENSION", OVER).call("INVENTORY", "minecraft:ender_pearl", -5)
             .call("INVENTORY", "minecraft:gold_ingot", -4).call("DIED").call("DIED")
             .call("PLACED", "minecraft:white_bed").call("INVENTORY", "minecraft:cobblestone", 64)
             .call("KILLED", "minecraft:blaze").call("DIMENSION", END).call("PLACED", "minecraft:red_bed"))
    r = summary(spark, calls)
    assert (r.blaze_rods_collected, r.blaze_rods_used, r.pearls_used, r.deaths) == (9, 7, 5, 2)
    assert (r.gold_traded, r.beds_used, r.blaze_kills) == (5 + 18, 1, 1)


def test_a_tick_counts_in_the_phase_it_began_in(spark):
    """The change and the loss fall on tick 0: the tick is overworld, the loss is nether."""
    r = summary(spark, Calls("order").ticks(1).call("DIMENSION", NETHER)
                .call("INVENTORY", "minecraft:gold_ingot", -3).ticks(1))
    assert (r.overworld_ticks, r.nether_ticks, r.gold_traded, r.portal_build_tick) == (1, 1, 3, 1)


def test_first_and_last_wins(spark):
    calls = (Calls("wins").ticks(1).call("ADVANCEMENT", "minecraft:nether/find_fortress")
             .call("KILLED", "minecraft:ender_dragon").ticks(4)
             .call("ADVANCEMENT", "minecraft:nether/find_fortress").call("KILLED", "minecraft:ender_dragon"))
    r = summary(spark, calls)
    assert (r.fortress_enter_tick, r.kill_tick) == (1, 5)


def test_unknown_dimension_is_overworld(spark):
    r = summary(spark, Calls("sky").ticks(1).call("DIMENSION", END).ticks(1).call("DIMENSION", "mod:sky").ticks(2))
    assert (r.overworld_ticks, r.end_ticks) == (3, 1)


def test_run_ids_differ_and_repeat(spark):
    stream = spark.createDataFrame(Calls("a").ticks(1).rows + Calls("b").ticks(1).rows, S.TRACKER)
    ids = {r.run_id for r in runs.run_summary(stream).collect()}
    assert len(ids) == 2 and ids == {r.run_id for r in runs.run_summary(stream).collect()}


def test_summary_schema_and_json(spark):
    stream = spark.createDataFrame(win().rows, S.TRACKER)
    sessions = spark.createDataFrame([("win", 77, '0.1 "x"\\')], "session_id string, started_at_ms long, mod_version string")
    table = runs.run_summary(stream, sessions)
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in S.RUN_SUMMARY]
    text = runs.summary_json(table).first()["json"]
    assert text.startswith('{"run_id":"') and '"started_at_ms":77' in text
    assert r'"mod_version":"0.1 \"x\"\\"' in text


def scalar_fold(calls):
    """The tracker as one loop over ordered calls."""
    phase, total = 0, 0
    out = {n: 0 for n in ("overworld_ticks", "nether_ticks", "end_ticks", "blaze_rods_used",
                          "blaze_rods_collected", "blaze_kills", "pearls_used", "beds_used",
                          "gold_traded", "deaths")}
    marks = {n: -1 for n in ("portal_build_tick", "dragon_enter_tick", "kill_tick",
                             *S.MILESTONE_ADVANCEMENTS.values())}
    for _, _, _, _, kind, name, delta in sorted(calls, key=lambda c: (c[2], c[3])):
        if kind == "TICK":
            total += 1
            out[("overworld_ticks", "nether_ticks", "end_ticks")[phase]] += 1
        elif kind == "DIMENSION":
            phase = {NETHER: 1, END: 2}.get(name, 0)
            mark = {NETHER: "portal_build_tick", END: "dragon_enter_tick"}.get(name)
            if mark and marks[mark] == -1:
                marks[mark] = total
        elif kind == "DIED":
            out["deaths"] += 1
        elif kind == "TRADE":
            out["gold_traded"] += delta
        elif kind == "KILLED":
            if name == "minecraft:ender_dragon":
                marks["kill_tick"] = total
            elif name == "minecraft:blaze":
                out["blaze_kills"] += 1
        elif kind == "PLACED":
            out["beds_used"] += phase == 2 and name.endswith("_bed")
        elif kind == "ADVANCEMENT":
            mark = S.MILESTONE_ADVANCEMENTS.get(name)
            if mark and marks[mark] == -1:
                marks[mark] = total
        elif name == "minecraft:blaze_rod":
            out["blaze_rods_used" if delta < 0 else "blaze_rods_collected"] += abs(delta)
        elif name == "minecraft:ender_pearl":
            out["pearls_used"] += max(-delta, 0)
        elif name == "minecraft:gold_ingot" and phase == 1:
            out["gold_traded"] += max(-delta, 0)
    return {**out, **marks, "duration_ticks": total}


def random_session(rng, name):
    calls = Calls(name)
    for _ in range(rng.randint(1, 60)):
        calls.ticks(1)
        if rng.random() < 0.3:
            calls.call("DIMENSION", rng.choice([NETHER, END, OVER, "mod:sky"]))
        for _ in range(rng.randint(0, 3)):
            calls.call(*rng.choice([
                ("DIED",), ("TRADE", None, rng.randint(1, 9)),
                ("KILLED", rng.choice(["minecraft:ender_dragon", "minecraft:blaze", "minecraft:cow"])),
                ("PLACED", rng.choice(["minecraft:red_bed", "minecraft:bedrock"])),
                ("ADVANCEMENT", rng.choice([*S.MILESTONE_ADVANCEMENTS, "minecraft:story/root"])),
                ("INVENTORY", rng.choice(["minecraft:blaze_rod", "minecraft:ender_pearl",
                                          "minecraft:gold_ingot", "minecraft:dirt"]),
                 rng.choice([-3, -1, 2, 5]))]))
    return calls.rows


@pytest.mark.parametrize("width", [None, 1, 7])
def test_random_streams_equal_the_scalar_fold(spark, width):
    rng = random.Random(5)
    sessions = {f"s{i}": random_session(rng, f"s{i}") for i in range(25)}
    everything = [c for calls in sessions.values() for c in calls]
    rng.shuffle(everything)
    got = runs.run_summary(spark.createDataFrame(everything, S.TRACKER), width=width).collect()
    assert len(got) == len(sessions)
    for r in got:
        want = scalar_fold(sessions[r.session_id])
        assert {n: r[n] for n in want} == want, r.session_id


@pytest.mark.parametrize("width", [None, 3])
def test_live_state_ends_at_the_summary(spark, width):
    rng = random.Random(9)
    sessions = {f"s{i}": random_session(rng, f"s{i}") for i in range(8)}
    stream = spark.createDataFrame([c for calls in sessions.values() for c in calls], S.TRACKER)
    live = runs.live_state(stream, width=width)
    for r in live.collect():
        seen = [c for c in sessions[r.session_id] if c[2] <= r.tick]
        want = scalar_fold(seen)
        for n in ("overworld_ticks", "nether_ticks", "end_ticks", "gold_traded", "beds_used", "kill_tick",
                  "portal_build_tick", "bastion_enter_tick", "deaths"):
            assert r[n] == want[n], (r.session_id, r.tick, n)


def test_advancement_map_is_exploded(spark):
    update = spark.createDataFrame([(1, {"a": 1, "b": 2})], "event_id long, earned map<string,int>")
    assert rows(runs.advancement_rows(update), "advancement") == [(1, "a"), (1, "b")]
    assert runs.advancement_rows(update).where(F.lit(True)).count() == 2
