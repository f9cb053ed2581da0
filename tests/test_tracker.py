"""Observed ticks to tracker calls, against a recorder written as one loop."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_runs import END, NETHER, OVER, scalar_fold
from tickframe import schemas as S
from tickframe.operators import inventory, runs, segments, tracker
from tickframe.plans import QUERIES


def recorder(ticks):
    """Calls of one session, in order: (tick, kind, name, delta)."""
    dimension, alive, held = None, True, {}
    for _, _, tick, seen, lives, slots, happened in sorted(ticks, key=lambda t: t[2]):
        yield tick, "TICK", None, None
        if seen is not None and seen != dimension:
            if dimension is not None:
                yield tick, "DIMENSION", seen, None
            dimension = seen
        if lives is not None:
            if alive and not lives:
                yield tick, "DIED", None, None
            alive = lives
        if slots is not None:
            now = {}
            for _, item, count in slots:
                if item is not None and count is not None and count > 0:
                    now[item] = now.get(item, 0) + count
            for item in sorted({*now, *held}):
                if now.get(item, 0) != held.get(item, 0):
                    yield tick, "INVENTORY", f"minecraft:{item}", now.get(item, 0) - held.get(item, 0)
            held = now
        for kind, name, delta in happened or []:
            if kind != "STATUS":
                yield tick, kind, name, delta
            elif delta == 3 and name is not None:
                yield tick, "KILLED", name, None


def random_ticks(rng, session, holes):
    out = []
    for tick in range(rng.randint(1, 40)):
        if holes and rng.random() < 0.3:
            continue
        slots = [(k, rng.choice(["blaze_rod", "ender_pearl", "gold_ingot", None]), rng.choice([0, 1, 2, 5, None])) for k in range(rng.randint(0, 3))]
        happened = [rng.choice([("STATUS", "minecraft:ender_dragon", 3), ("STATUS", "minecraft:blaze", 3), ("STATUS", "minecraft:blaze", 2),
                                ("STATUS", None, 3), ("PLACED", "minecraft:red_bed", None), ("TRADE", None, 4),
                                ("ADVANCEMENT", "minecraft:nether/find_bastion", None)]) for _ in range(rng.randint(0, 2))]
        out.append((session, f"p-{session}", tick, rng.choice([None, OVER, NETHER, END, "mod:sky"]), rng.choice([True, True, False, None]),
                    rng.choice([None, slots, slots]), rng.choice([None, happened])))
    return out


def sessions(seed, holes):
    rng = random.Random(seed)
    return {f"s{k}": random_ticks(rng, f"s{k}", holes) for k in range(20)}


@pytest.mark.parametrize("width", [None, 1, 3])
@pytest.mark.parametrize("holes", [False, True])
def test_calls_are_those_of_the_recorder(spark, width, holes):
    made = sessions(7, holes)
    rows = [t for ticks in made.values() for t in ticks]
    random.Random(1).shuffle(rows)
    calls = tracker.tracker_calls(spark.createDataFrame(rows, S.OBSERVED).withColumn("more", F.lit(5)), width)
    assert calls.columns == [*S.TRACKER.names, "call_no", "more"]
    got = {}
    for r in calls.orderBy("session_id", "call_no").collect():
        got.setdefault(r["session_id"], []).append((r["tick"], r["kind"], r["name"], r["delta"]))
    assert got == {s: list(recorder(ticks)) for s, ticks in made.items() if ticks}


@pytest.mark.parametrize("width", [None, 2])
def test_snapshots_lead_to_the_summary(spark, width):
    made = sessions(3, True)
    observed = spark.createDataFrame([t for ticks in made.values() for t in ticks], S.OBSERVED)
    summaries = runs.run_summary(tracker.tracker_calls(observed, width, segmented=True)).collect()
    assert len(summaries) == len([t for t in made.values() if t])
    for r in summaries:
        ranks = {"TICK": 0, "DIMENSION": 1}
        want = scalar_fold([(None, None, t, ranks.get(kind, 2), kind, name, delta)
                            for t, kind, name, delta in recorder(made[r["session_id"]])])
        assert {n: r[n] for n in want} == want, r["session_id"]


def test_milestones_count_ticks_and_not_their_numbers(spark):
    rows = [("s", "p", t, d, True, None, None) for t, d in ((10, OVER), (20, OVER), (400, NETHER), (9000, END))]
    r = runs.run_summary(tracker.tracker_calls(spark.createDataFrame(rows, S.OBSERVED)), width=100).first()
    assert (r.portal_build_tick, r.dragon_enter_tick, r.duration_ticks) == (3, 4, 4)


def test_awkward_observations(spark):
    rows = [(None, "p", 1, OVER, True, None, None), ("s", None, 1, OVER, True, None, None),
            ("s", "p", 0, None, None, None, None), ("s", "p", 5, None, False, [], [])]
    got = tracker.tracker_calls(spark.createDataFrame(rows, S.OBSERVED)).orderBy("call_no").collect()
    assert [(r.tick, r.kind) for r in got] == [(0, "TICK"), (5, "TICK"), (5, "DIED")]
    assert tracker.tracker_calls(spark.createDataFrame([], S.OBSERVED)).count() == 0


def final_plan(df):
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["tracker_calls", "live_state", "yaw_deltas_session", "death_edges"])
def test_the_rows_are_scanned_once(spark, name):
    text = final_plan(QUERIES[name](spark, SMALL))
    scans = [line for line in text.split("\n") if "FileScan" in line and "numbered-" in line]
    assert len(scans) == 1 and "ReusedExchange" in text


@pytest.mark.parametrize("width", [None, 1, 4])
def test_neighbours_across_borders(spark, width):
    rng = random.Random(8)
    rows = sorted({(rng.choice("ab"), rng.randint(0, 60)) for _ in range(50)})
    frame = spark.createDataFrame([(k, t, t * 10) for k, t in rows], "k string, t long, v long").repartition(3)
    got = {(r.k, r.t): r for r in segments.previous(frame, ["k"], "t", {"was": F.col("v")}, width).collect()}
    ahead = {(r.k, r.t): r.following for r in segments.following(frame, ["k"], "t", "following", width).collect()}
    known = segments.last_known_before(frame, ["k"], "t", {"odd": F.expr("IF(t % 2 = 1, t, NULL)")}, width)
    odd = {(r.k, r.t): r.odd for r in known.collect()}
    for key in "ab":
        own = [t for k, t in rows if k == key]
        for i, t in enumerate(own):
            assert got[key, t].was == ((own[i - 1] * 10,) if i else None)
            assert ahead[key, t] == (own[i + 1] if i + 1 < len(own) else None)
            assert odd[key, t] == max((x for x in own[:i] if x % 2), default=None)


@pytest.mark.parametrize("reset", [None, 8])
@pytest.mark.parametrize("width", [None, 3])
def test_deltas_between_observed_snapshots(spark, reset, width):
    rng = random.Random(6)
    seen = {s: sorted(rng.sample(range(60), 25)) for s in ("a", "b")}
    held = {(s, t): {i: rng.randint(1, 3) for i in rng.sample("xyz", rng.randint(0, 2))} for s, ticks in seen.items() for t in ticks}
    totals = spark.createDataFrame([(s, t, i, n) for (s, t), items in held.items() for i, n in items.items()],
                                   "session_id string, tick long, item string, count long")
    ticks = spark.createDataFrame(list(held), "session_id string, tick long")
    want = set()
    for s, own in seen.items():
        for k, t in enumerate(own):
            fresh = k == 0 or (reset is not None and own[k - 1] // reset != t // reset)
            before, now = ({} if fresh else held[s, own[k - 1]]), held[s, t]
            want |= {(s, t, i, now.get(i, 0), before.get(i, 0), now.get(i, 0) - before.get(i, 0))
                     for i in {*now, *before} if now.get(i, 0) != before.get(i, 0)}
    got = inventory.observed_deltas(totals, ticks, reset, width)
    assert {tuple(r) for r in got.collect()} == want
