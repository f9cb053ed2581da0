"""Observed ticks to the rows of the event log, types 0 to 7 in the order of the file.

The log differs from the tracker's calls: inventories are compared within a chunk only, so the first tick of a
chunk tells all that is held again, and a tick's rows come in another order. All kinds are derived in one pass over
a segment; what a tick is compared with is carried over its border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.labels import name_contains
from tickframe.functions.text import boss_health_fixed, decode_tolerant, equipment_text, limit_bytes
from tickframe.operators import segments
from tickframe.operators.tracker import item_counts
from tickframe.schemas import CALLS_PER_TICK, CHUNK_TICKS, EQUIPMENT_SLOTS, EVENT_TYPES, SEEN

_KEYS = ("session_id", "player_id")
_ROW = "struct<event_type:smallint,item_name:string,count:smallint,prev_count:smallint>"
_COUNTS = "array<struct<item:string,count:bigint>>"
_STACKS = "array<struct<slot:int,item:string,enchanted:boolean,count:int>>"
_CODES = {name: code for code, name in EVENT_TYPES.items()}


def _row(kind: str, name: Column, count: Column | None = None, prev: Column | None = None) -> Column:
    """A row as the file stores it: names are cut to their byte limit, counts to 16 bits."""
    short = lambda n: F.lit(0).cast("smallint") if n is None else _wrapped(n)
    return F.struct(F.lit(_CODES[kind]).alias("event_type"), decode_tolerant(limit_bytes(name)).alias("item_name"),
                    short(count).alias("count"), short(prev).alias("prev_count")).cast(_ROW)


def _wrapped(n: Column) -> Column:
    """The low 16 bits as a signed number."""
    low = n.cast("long").bitwiseAND(F.lit(0xFFFF))
    return F.when(low > 0x7FFF, low - 0x10000).otherwise(low).cast("smallint")


def _rows(condition: Column, row: Column) -> Column:
    return F.when(condition, F.array(row)).otherwise(F.array().cast(f"array<{_ROW}>"))


def _none() -> Column:
    return F.array().cast(f"array<{_ROW}>")


def _count_of(entries: Column, item: Column) -> Column:
    found = F.filter(entries, lambda e: e["item"] == item)
    return F.coalesce(F.get(found, F.lit(0))["count"], F.lit(0).cast("long"))


def _inventory(before: Column, now: Column) -> Column:
    items = F.array_sort(F.array_union(F.transform(before, lambda e: e["item"]), F.transform(now, lambda e: e["item"])))
    changed = F.filter(items, lambda i: _count_of(before, i) != _count_of(now, i))
    return F.transform(changed, lambda i: _row("INVENTORY_DELTA", i, _count_of(now, i), _count_of(before, i)))


def _equipment(before: Column, now: Column) -> Column:
    """A row for every slot whose whole stack differs, in the order of the slots."""
    names = F.array(*[F.lit(n) for n in EQUIPMENT_SLOTS])
    slots = F.sequence(F.lit(0), F.lit(len(EQUIPMENT_SLOTS) - 1))
    stack = lambda entries, slot: F.get(F.filter(entries, lambda e: e["slot"] == slot), F.lit(0))
    changed = F.filter(slots, lambda s: ~stack(before, s).eqNullSafe(stack(now, s)))
    text = lambda s: equipment_text(F.get(names, s), F.coalesce(stack(now, s)["item"], F.lit("empty")),
                                    F.coalesce(stack(now, s)["enchanted"], F.lit(False)))
    return F.transform(changed, lambda s: _row("EQUIPMENT_CHANGE", text(s), F.lit(1)))


def _boss(before: Column, percents: Column) -> Column:
    """A row for every bar that differs from the one before it, in this tick or an earlier one."""
    chain = F.concat(F.array(before), percents)
    places = F.sequence(F.lit(1), F.size(percents))
    changed = F.filter(places, lambda k: F.get(chain, k) != F.get(chain, k - 1))
    rows = F.transform(changed, lambda k: _row("DRAGON_HEALTH", F.lit("ender_dragon"), boss_health_fixed(F.get(chain, k))))
    return F.when(F.size(percents) > 0, rows).otherwise(_none())


def event_rows(seen: DataFrame, boss: str = "Ender Dragon", chunk_ticks: int = CHUNK_TICKS, width: int | None = None) -> DataFrame:
    """``schemas.EVENTS`` of every session, with ``session_id, player_id, chunk_index`` and ``event_no``, which gives the file order.

    ``seen`` has one row per session, player and tick (``schemas.SEEN``). A null field was not seen and changes
    nothing. A session starts alive and awake, with empty slots and no dimension; an inventory is compared with the
    last one of its chunk, and the first of a chunk with nothing (T2).
    """
    none, bare = F.array().cast(_COUNTS), F.array().cast(_STACKS)
    chunk = F.call_function("div", F.col("tick"), F.lit(chunk_ticks)).cast("int")
    matching = F.transform(F.filter("bars", lambda b: name_contains(b["name"], boss) & b["percent"].isNotNull()), lambda b: b["percent"])
    held = (seen.select(*[c for c in seen.columns if c != "bars"], chunk.alias("chunk_index"),
                        F.coalesce(matching, F.array().cast("array<double>")).alias("_percents"))
            .withColumn("inventory", item_counts(F.col("inventory")))
            .withColumn("equipment", F.filter("equipment", lambda e: e["item"].isNotNull())))
    states = {"_alive": F.col("alive"), "_sleeping": F.col("sleeping"), "_dimension": F.col("dimension"), "_equipment": F.col("equipment"),
              "_inventory": F.when(F.col("inventory").isNotNull(), F.struct("chunk_index", F.col("inventory").alias("items"))),
              "_percent": F.get("_percents", F.size("_percents") - 1)}
    known = segments.last_known_before(held, _KEYS, "tick", states, width)
    same_chunk = F.col("_inventory.chunk_index") == F.col("chunk_index")
    hooked = F.filter("happened", lambda h: h["kind"].isin("CRAFTED", "ADVANCEMENT"))
    rows = F.concat(
        F.when(F.col("inventory").isNotNull(), _inventory(F.when(same_chunk, F.col("_inventory.items")).otherwise(none), F.col("inventory"))).otherwise(_none()),
        _rows(~F.col("alive") & F.coalesce("_alive", F.lit(True)), _row("PLAYER_DIED", F.lit("player"))),
        _rows(F.col("sleeping") & ~F.coalesce("_sleeping", F.lit(False)), _row("SLEPT", F.lit("bed"))),
        _rows(F.col("dimension") != F.col("_dimension"), _row("DIMENSION_CHANGE", F.col("dimension"))),
        F.when(F.col("equipment").isNotNull(), _equipment(F.coalesce("_equipment", bare), F.col("equipment"))).otherwise(_none()),
        _boss(F.coalesce("_percent", F.lit(-1.0)), F.col("_percents")),
        F.coalesce(F.transform(hooked, lambda h: F.when(h["kind"] == "CRAFTED", _row("CRAFTED", h["name"], h["delta"]))
                               .otherwise(_row("ADVANCEMENT", h["name"]))), _none()))
    return (known.select(*_KEYS, "tick", "chunk_index", F.posexplode(rows).alias("_place", "_event"))
            .select(*_KEYS, "chunk_index", F.col("tick").cast("int").alias("tick"), "_event.*",
                    (F.col("tick").cast("long") * CALLS_PER_TICK + F.col("_place")).alias("event_no")))


def empty_seen(observed: DataFrame) -> DataFrame:
    """``observed`` with null for what it lacks of ``schemas.SEEN``."""
    missing = [f for f in SEEN if f.name not in observed.columns]
    return observed.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
