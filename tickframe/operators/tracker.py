"""Observed ticks to the calls of the run tracker (W3, W5, J3, J6 in the order of T5).

One pass over the ticks of a segment derives every kind of call. What a tick is compared with is the last
known dimension, life and inventory before it, so a session may have holes: a missing tick, or a tick whose
inventory could not be read, is no empty one. The three states are carried over segment borders together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.labels import qualify_item
from tickframe.operators import segments
from tickframe.schemas import CALLS_PER_TICK, ENTITY_DIED, OBSERVED, RANK_DIMENSION, RANK_OTHER, RANK_TICK

_KEYS = ("session_id", "player_id")
_CALL = "struct<rank:int,kind:string,name:string,delta:int>"
_COUNTS = "array<struct<item:string,count:bigint>>"


def _summed(entries: Column) -> Column:
    """Entries with ``item`` and ``count`` added up by item, in the order of the items."""
    items = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["item"])))
    return F.transform(items, lambda i: F.struct(i.alias("item"), F.aggregate(
        F.filter(entries, lambda e: e["item"] == i), F.lit(0).cast("long"), lambda total, e: total + e["count"]).alias("count")))


def item_counts(inventory: Column) -> Column:
    """Count per item over the slots that hold something, as a sorted list; null if the inventory is null.

    An inventory has at most 41 slots, so the list has a bound.
    """
    held = F.filter(inventory, lambda s: s["item"].isNotNull() & (s["count"] > 0))
    return _summed(F.transform(held, lambda s: F.struct(s["item"].alias("item"), s["count"].cast("long").alias("count")))).cast(_COUNTS)


def item_changes(before: Column, now: Column) -> Column:
    """Items whose count differs, with the difference; an absent item counts 0 and null is an empty list."""
    none = F.array().cast(_COUNTS)
    taken = F.transform(F.coalesce(before, none), lambda e: F.struct(e["item"].alias("item"), (-e["count"]).alias("count")))
    return F.filter(_summed(F.concat(F.coalesce(now, none), taken)), lambda e: e["count"] != 0)


def _call(rank: int, kind: str, name: Column | None = None, delta: Column | None = None) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                    (F.lit(None) if name is None else name).cast("string").alias("name"),
                    (F.lit(None) if delta is None else delta).cast("int").alias("delta")).cast(_CALL)


def _only(condition: Column, call: Column) -> Column:
    return F.when(condition, F.array(call)).otherwise(F.array().cast(f"array<{_CALL}>"))


def _hooked(happened: Column) -> Column:
    """Calls of the hooks, in their order. An entity status counts if the entity died and is known."""
    kept = F.filter(happened, lambda h: (h["kind"] != "STATUS") | ((h["delta"] == ENTITY_DIED) & h["name"].isNotNull()))
    as_call = F.transform(kept, lambda h: F.when(h["kind"] == "STATUS", _call(RANK_OTHER, "KILLED", h["name"])).otherwise(
        F.struct(F.lit(RANK_OTHER).alias("rank"), h["kind"].alias("kind"), h["name"].alias("name"), h["delta"].alias("delta")).cast(_CALL)))
    return F.coalesce(as_call, F.array().cast(f"array<{_CALL}>"))


def tracker_calls(observed: DataFrame, width: int | None = None, segmented: bool = False) -> DataFrame:
    """Calls of ``schemas.TRACKER`` with ``call_no``, which orders the calls of a session.

    ``observed`` has one row per session, player and tick seen (``schemas.OBSERVED``); further columns are
    carried along to each call of the tick. Null dimension, life or inventory means not seen: the
    state stays. A session starts alive, with nothing held and in no known dimension; its first dimension is
    no change (T4), and what it holds at its first sight counts as gained (T3). With ``segmented`` the
    rows keep the column of their segment, so that what follows on the same segments adds no shuffle.
    """
    more = [c for c in observed.columns if c not in OBSERVED.names and c != segments.SEGMENT]
    held = observed.withColumn("inventory", item_counts(F.col("inventory")))
    states = {"_dimension": F.col("dimension"), "_alive": F.col("alive"), "_inventory": F.col("inventory")}
    seen = segments.last_known_before(held, _KEYS, "tick", states, width)
    changes = F.when(F.col("inventory").isNotNull(), item_changes(F.col("_inventory"), F.col("inventory")))
    calls = F.concat(
        F.array(_call(RANK_TICK, "TICK")),
        _only(F.col("dimension") != F.col("_dimension"), _call(RANK_DIMENSION, "DIMENSION", F.col("dimension"))),
        _only(~F.col("alive") & F.coalesce("_alive", F.lit(True)), _call(RANK_OTHER, "DIED")),
        F.coalesce(F.transform(changes, lambda e: _call(RANK_OTHER, "INVENTORY", qualify_item(e["item"]), e["count"])),
                   F.array().cast(f"array<{_CALL}>")),
        _hooked(F.col("happened")))
    keep = [*more, segments.SEGMENT] if segmented else more
    return (seen.select(*_KEYS, "tick", *keep, F.posexplode(calls).alias("_place", "_call"))
            .select(*_KEYS, "tick", "_call.*", (F.col("tick").cast("long") * CALLS_PER_TICK + F.col("_place")).alias("call_no"), *keep))
