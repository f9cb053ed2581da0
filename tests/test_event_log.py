"""The event log derived from ticks, against a writer that goes tick by tick."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickframe import schemas as S
from tickframe.operators import event_log
from tickframe.operators.tracker import tracker_calls

CHUNK = 6
SLOTS = [n.lower() for n in S.EQUIPMENT_SLOTS]


def writer(ticks):
    """(tick, type, name, count, prev_count) in file order."""
    alive, asleep, dimension, worn, percent, held, chunk = True, False, None, {}, -1.0, {}, None
    for t in sorted(ticks, key=lambda t: t["tick"]):
        at = t["tick"]
        if at // CHUNK != chunk:
            held, chunk = {}, at // CHUNK
        if t["inventory"] is not None:
            now = {}
            for _, item, n in t["inventory"]:
                if item is not None and (n or 0) > 0:
                    now[item] = now.get(item, 0) + n
            for item in sorted({*now, *held}):
                if now.get(item, 0) != held.get(item, 0):
                    yield at, 0, item, now.get(item, 0), held.get(item, 0)
            held = now
        if t["alive"] is not None:
            if alive and not t["alive"]:
                yield at, 2, "player", 0, 0
            alive = t["alive"]
        if t["sleeping"] is not None:
            if t["sleeping"] and not asleep:
                yield at, 3, "bed", 0, 0
            asleep = t["sleeping"]
        if t["dimension"] is not None and t["dimension"] != dimension:
            if dimension is not None:
                yield at, 4, t["dimension"], 0, 0
            dimension = t["dimension"]
        if t["equipment"] is not None:
            now = {e[0]: e[1:] for e in t["equipment"] if e[1] is not None}
            for slot in range(6):
                if now.get(slot) != worn.get(slot):
                    item, enchanted, _ = now.get(slot) or ("empty", False, 0)
                    yield at, 6, f"{SLOTS[slot]}:{item}{':ench' if enchanted else ''}", 1, 0
            worn = now
        for name, value in t["bars"] or []:
            if "ender dragon" in name.lower() and value != percent:
                yield at, 5, "ender_dragon", min(max(int(value * 100), 0), 10000), 0
                percent = value
        for kind, name, n in t["happened"] or []:
            if kind == "ADVANCEMENT":
                yield at, 7, name, 0, 0
            elif kind == "CRAFTED":
                yield at, 1, name, n, 0


def made_up(seed):
    rng = random.Random(seed)
    out = {}
    for k in range(12):
        out[f"s{k}"] = [{
            "tick": tick, "dimension": rng.choice([None, "a:b", "c:d"]), "alive": rng.choice([True, True, False, None]),
            "sleeping": rng.choice([False, True, None]),
            "inventory": rng.choice([None, [(i, rng.choice(["x", "y", None]), rng.choice([0, 1, 2, None])) for i in range(rng.randint(0, 3))]]),
            "equipment": rng.choice([None, [(s, rng.choice(["hat", "rod", None]), rng.random() < 0.5, rng.randint(1, 2)) for s in rng.sample(range(6), 3)]]),
            "bars": rng.choice([None, [(rng.choice(["Ender Dragon", "the ENDER dragon!", "Wither"]), rng.choice([0.0, 0.5, 1.0, 200.0])) for _ in range(rng.randint(0, 3))]]),
            "happened": rng.choice([None, [("ADVANCEMENT", "q/r", None), ("STATUS", "z", 3), ("CRAFTED", "plank", 4)]]),
        } for tick in range(rng.randint(1, 40)) if rng.random() < 0.8]
    return out


@pytest.mark.parametrize("width", [None, 1, 4])
def test_rows_are_those_of_the_writer(spark, width):
    made = made_up(5)
    rows = [(s, "p", t["tick"], t["dimension"], t["alive"], t["inventory"], t["happened"], t["sleeping"], t["equipment"], t["bars"])
            for s, ticks in made.items() for t in ticks]
    random.Random(2).shuffle(rows)
    out = event_log.event_rows(spark.createDataFrame(rows, S.SEEN), chunk_ticks=CHUNK, width=width)
    got = {}
    for r in out.orderBy("session_id", "event_no").collect():
        assert r.chunk_index == r.tick // CHUNK
        got.setdefault(r.session_id, []).append((r.tick, r.event_type, r.item_name, r["count"], r.prev_count))
    assert got == {s: list(writer(ticks)) for s, ticks in made.items() if list(writer(ticks))}


def test_names_and_counts_are_cut_as_in_the_file(spark):
    rows = [("s", "p", 0, None, None, [(0, "é" * 200, 70_000)], [("CRAFTED", "x" * 300, -1)], None, None, None)]
    got = event_log.event_rows(spark.createDataFrame(rows, S.SEEN)).orderBy("event_no").collect()
    assert [(r.event_type, r.item_name, r["count"]) for r in got] == [(0, "é" * 127 + "�", 70_000 - 65_536), (1, "x" * 255, -1)]


def test_plain_observations_do(spark):
    rows = [("s", "p", 0, "a", True, [(0, "x", 1)], None), ("s", "p", 1, "b", False, None, None)]
    observed = spark.createDataFrame(rows, S.OBSERVED)
    events = event_log.event_rows(event_log.empty_seen(observed))
    assert [(r.tick, r.event_type) for r in events.orderBy("event_no").collect()] == [(0, 0), (1, 2), (1, 4)]
    assert tracker_calls(observed).where(F.col("kind") == "DIED").count() == 1
    assert event_log.event_rows(event_log.empty_seen(spark.createDataFrame([], S.OBSERVED))).count() == 0
