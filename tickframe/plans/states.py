"""Edges, angles and carried state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions import labels
from tickframe.operators import edges, event_log
from tickframe.plans import workload as W
from tickframe.plans.registry import query
from tickframe.schemas import EQUIPMENT_SLOTS
from tickframe.sinks import tables
from tickframe.sinks.shared import new_shared_path
from tickframe.sources import documents

_T = f"WITH {W.TELEMETRY_SQL}"
_W = "OVER (PARTITION BY session_id ORDER BY ord)"


@query("dimension_changes", f"{_T},{W.CHANGES_SQL} SELECT session_id, tick, dimension FROM changes")
def dimension_changes(spark, sf_dir):
    return W.dimension_changes(W.telemetry(spark, sf_dir)).select("session_id", "tick", "dimension")


@query("dimension_codes", f"""{_T},
d AS (SELECT *, CASE WHEN k % 4 < 3 THEN ['minecraft:overworld', 'minecraft:the_nether',
      'minecraft:the_end'][k % 4 + 1] ELSE 'custom:sky' END AS dimension FROM tele)
SELECT event_id, dimension, CASE WHEN k % 4 < 3 THEN k % 4 ELSE -1 END AS code,
  ['OVERWORLD', 'NETHER', 'END', 'OVERWORLD'][k % 4 + 1] AS phase FROM d""")
def dimension_codes(spark, sf_dir):
    names = F.array(*[F.lit(d) for d in (*W.DIMENSIONS, "custom:sky")])
    seen = W.telemetry(spark, sf_dir).select(
        "event_id", F.element_at(names, F.col("k") % 4 + 1).alias("dimension"))
    return seen.select("*", labels.dimension_code(F.col("dimension")).cast("int").alias("code"),
                       labels.phase(F.col("dimension")).alias("phase"))


@query("death_edges", f"""{_T},
e AS (SELECT *, NOT (event_type = 'error' AND k % 10 = 0) AS alive FROM tele)
SELECT session_id, ord, tick FROM (SELECT *, lag(alive, 1, true) {_W} AS was FROM e)
WHERE was AND NOT alive""")
def death_edges(spark, sf_dir):
    died = (F.col("event_type") == "error") & (F.col("k") % 10 == 0)
    seen = W.telemetry(spark, sf_dir).select("session_id", "ord", "tick", (~died).alias("alive"))
    return edges.death_edges(seen, order="ord").select("session_id", "ord", "tick")


@query("sleep_onsets", f"""{_T},
e AS (SELECT *, event_type = 'view' AND k % 4 = 0 AS sleeping FROM tele)
SELECT session_id, ord, tick FROM (SELECT *, lag(sleeping, 1, false) {_W} AS was FROM e)
WHERE sleeping AND NOT was""")
def sleep_onsets(spark, sf_dir):
    sleeping = (F.col("event_type") == "view") & (F.col("k") % 4 == 0)
    seen = W.telemetry(spark, sf_dir).select("session_id", "ord", "tick", sleeping.alias("sleeping"))
    return edges.sleep_onsets(seen, order="ord").select("session_id", "ord", "tick")


_SLOTS = ("MAINHAND", "OFFHAND", "FEET", "LEGS", "CHEST", "HEAD")


@query("equipment_changes", f"""{_T},
s AS (SELECT session_id, ord, tick, {list(_SLOTS)}[k % 6 + 1] AS slot,
        CASE WHEN k % 7 > 0 THEN 'item_' || (k % 5) END AS item,
        CASE WHEN k % 7 > 0 THEN k % 2 = 0 END AS enchanted,
        CASE WHEN k % 7 > 0 THEN 1 + k % 3 END AS count FROM tele),
v AS (SELECT *, coalesce(item || '|' || enchanted || '|' || count, '') AS stack FROM s)
SELECT session_id, slot, ord, tick,
  lower(slot) || ':' || coalesce(item, 'empty') || CASE WHEN enchanted THEN ':ench' ELSE '' END AS equipment
FROM (SELECT *, lag(stack, 1, '') OVER (PARTITION BY session_id, slot ORDER BY ord) AS was FROM v)
WHERE stack <> was""")
def equipment_changes(spark, sf_dir):
    held = F.col("k") % 7 > 0
    slots = F.array(*[F.lit(s) for s in _SLOTS])
    stacks = W.telemetry(spark, sf_dir).select(
        "session_id", "ord", "tick", F.element_at(slots, F.col("k") % 6 + 1).alias("slot"),
        F.when(held, F.concat(F.lit("item_"), (F.col("k") % 5).cast("string"))).alias("item"),
        F.when(held, F.col("k") % 2 == 0).alias("enchanted"),
        F.when(held, 1 + F.col("k") % 3).alias("count"))
    return edges.equipment_changes(stacks, order="ord").select(
        "session_id", "slot", "ord", "tick", "equipment")


@query("boss_health_changes", f"""{_T},
b AS (SELECT *, round(value, 0) / 100 AS percent FROM tele)
SELECT session_id, ord, tick, percent,
  least(greatest(CAST(trunc(percent * 100) AS INTEGER), 0), 10000) AS health_fixed
FROM (SELECT *, lag(percent, 1, -1.0) {_W} AS was FROM b WHERE event_type = 'view')
WHERE percent <> was""")
def boss_health_changes(spark, sf_dir):
    """Bars of ``click`` rows belong to another boss and are passed over; other rows show no bar."""
    kind = F.col("event_type")
    bars = W.telemetry(spark, sf_dir).select(
        "session_id", "ord", "tick", (F.round("value", 0) / 100).alias("percent"),
        F.when(kind == "view", "the ENDER dragon").when(kind == "click", "Wither").alias("bar_name"))
    return edges.boss_health_changes(bars, order="ord").drop("bar_name")


def _angles(spark, sf_dir, chunk_ticks: int = 8):
    ticks = W.telemetry(spark, sf_dir).select(
        "session_id", "ord", "tick", (F.col("value") * 7 % 720 - 360).alias("player_yaw"),
        (F.col("k") - 50).cast("double").alias("player_pitch"))
    return edges.add_chunk(ticks, chunk_ticks)


def _wrap(d: str) -> str:
    return (f"CASE WHEN {d} > 180 THEN {d} - 360.0 * ceil(({d} - 180) / 360.0) "
            f"WHEN {d} < -180 THEN {d} + 360.0 * ceil((-180 - {d}) / 360.0) ELSE {d} END")


def _deltas_sql(keys: str) -> str:
    return f"""{_T},
a AS (SELECT session_id, ord, value * 7 % 720 - 360 AS yaw, CAST(k - 50 AS DOUBLE) AS pitch,
        tick // 8 AS chunk_index FROM tele),
d AS (SELECT *, yaw - lag(yaw) OVER w AS dy, pitch - lag(pitch) OVER w AS dp FROM a
      WINDOW w AS (PARTITION BY {keys} ORDER BY ord))
SELECT session_id, ord, round(coalesce({_wrap('dy')}, 0.0), 6) + 0.0 AS yaw_delta,
  coalesce(dp, 0.0) AS pitch_delta FROM d"""


def _delta_columns(df):
    return df.select("session_id", "ord", (F.round("yaw_delta", 6) + 0.0).alias("yaw_delta"),
                     "pitch_delta")


@query("yaw_deltas", _deltas_sql("session_id, chunk_index"))
def yaw_deltas(spark, sf_dir):
    """As the log stores them: each chunk starts from no previous angle."""
    return _delta_columns(edges.angle_deltas(_angles(spark, sf_dir), order="ord"))


@query("yaw_deltas_session", _deltas_sql("session_id"))
def yaw_deltas_session(spark, sf_dir):
    return _delta_columns(edges.angle_deltas(_angles(spark, sf_dir), ["session_id"], order="ord"))


@query("yaw_unwrap", f"""{_T},
a AS (SELECT session_id, ord, CAST((value * 1000 + k * 600) % 65536 AS INTEGER) - 32768 AS fp FROM tele),
t AS (SELECT *, CASE WHEN fp - was > 32768 THEN -1 WHEN fp - was < -32768 THEN 1 ELSE 0 END AS turns
      FROM (SELECT *, lag(fp) {_W} AS was FROM a))
SELECT session_id, ord, (fp + 65536 * CAST(sum(turns) OVER (PARTITION BY session_id ORDER BY ord
  ROWS UNBOUNDED PRECEDING) AS BIGINT)) / 100.0 AS yaw_unwrapped FROM t""")
def yaw_unwrap(spark, sf_dir):
    raw = F.floor((F.col("value") * 1000 + F.col("k") * 600) % 65536 + 0.5).cast("int") - 32768
    ticks = W.telemetry(spark, sf_dir).select("session_id", "ord", raw.alias("yaw_fp"))
    return edges.unwrap_yaw(ticks, order="ord").select("session_id", "ord", "yaw_unwrapped")


@query("hotbar_slots", f"""{_T}
SELECT session_id, ord, last_value(CASE WHEN k % 12 - 2 BETWEEN 0 AND 8 THEN k % 12 - 2 END IGNORE NULLS)
  OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS selected_slot FROM tele""")
def hotbar_slots(spark, sf_dir):
    asked = W.telemetry(spark, sf_dir).select(
        "session_id", "ord", (F.col("k") % 12 - 2).alias("inventory_slot"))
    return edges.held_slot(asked, order="ord").select("session_id", "ord", "selected_slot")


EVENT_CHUNK_TICKS = 8

_EVENTS = f"""{_T},{W.CHANGES_SQL},
flags AS (SELECT session_id, tick, bool_or(event_type = 'error' AND k % 10 = 0) AS dead, bool_or(event_type = 'view' AND k % 4 = 0) AS asleep
          FROM tele GROUP BY ALL),
turns AS (SELECT *, lag(dead, 1, false) OVER w AS was_dead, lag(asleep, 1, false) OVER w AS was_asleep FROM flags
          WINDOW w AS (PARTITION BY session_id ORDER BY tick)),
shown AS (SELECT session_id, tick, lead(tick) OVER (PARTITION BY session_id, tick // {EVENT_CHUNK_TICKS} ORDER BY tick) AS next_tick
          FROM (SELECT DISTINCT session_id, tick FROM tele WHERE event_type = 'purchase')),
held AS (SELECT session_id, tick, {W.ITEM_SQL} AS item, sum(k % 9) AS n FROM tele WHERE event_type = 'purchase' GROUP BY ALL),
items AS (SELECT session_id, tick, item, sum(n) AS count, sum(was) AS prev_count FROM (
            SELECT session_id, tick, item, n, 0 AS was FROM held
            UNION ALL SELECT session_id, next_tick, item, 0, n FROM held JOIN shown USING (session_id, tick) WHERE next_tick IS NOT NULL)
          GROUP BY ALL HAVING sum(n) <> sum(was)),
worn AS (SELECT session_id, tick, ord % 2 * 3 + k % 3 AS slot, 'item_' || (k % 5) AS item, k % 2 = 0 AS ench, 1 + k % 3 AS n
         FROM tele WHERE event_type = 'click' AND k % 7 > 0),
looks AS (SELECT session_id, tick, lag(tick) OVER (PARTITION BY session_id ORDER BY tick) AS was_tick
          FROM (SELECT DISTINCT session_id, tick FROM tele WHERE event_type = 'click')),
slots AS (SELECT l.session_id, l.tick, s.slot, a.item, a.ench, a.n, b.item AS was_item, b.ench AS was_ench, b.n AS was_n
          FROM looks l, (SELECT unnest(range(6)) AS slot) s
          LEFT JOIN worn a ON a.session_id = l.session_id AND a.tick = l.tick AND a.slot = s.slot
          LEFT JOIN worn b ON b.session_id = l.session_id AND b.tick = l.was_tick AND b.slot = s.slot),
bars AS (SELECT session_id, tick, round(value, 0) / 100 AS percent, lag(round(value, 0) / 100, 1, -1.0) OVER (PARTITION BY session_id ORDER BY ord) AS was
         FROM tele WHERE event_type = 'view'),
log AS (
  SELECT session_id, tick, 'INVENTORY_DELTA' AS event_type, item AS item_name, count, prev_count FROM items
  UNION ALL SELECT session_id, tick, 'PLAYER_DIED', 'player', 0, 0 FROM turns WHERE dead AND NOT was_dead
  UNION ALL SELECT session_id, tick, 'SLEPT', 'bed', 0, 0 FROM turns WHERE asleep AND NOT was_asleep
  UNION ALL SELECT session_id, tick, 'DIMENSION_CHANGE', dimension, 0, 0 FROM changes
  UNION ALL SELECT session_id, tick, 'EQUIPMENT_CHANGE', lower({list(EQUIPMENT_SLOTS)}[slot + 1]) || ':' || coalesce(item, 'empty')
    || CASE WHEN ench THEN ':ench' ELSE '' END, 1, 0 FROM slots
    WHERE item IS DISTINCT FROM was_item OR ench IS DISTINCT FROM was_ench OR n IS DISTINCT FROM was_n
  UNION ALL SELECT session_id, tick, 'DRAGON_HEALTH', 'ender_dragon', least(greatest(CAST(trunc(percent * 100) AS INTEGER), 0), 10000), 0 FROM bars WHERE percent <> was
  UNION ALL SELECT session_id, tick, 'ADVANCEMENT', {W.ADVANCEMENT_SQL}, 0, 0 FROM tele WHERE event_type = 'view')"""


@query("derived_events", f"""{_EVENTS}
SELECT session_id, CAST(tick AS INTEGER) AS tick, event_type, item_name, CAST(count AS INTEGER) AS count, CAST(prev_count AS INTEGER) AS prev_count FROM log""")
def derived_events(spark, sf_dir):
    """The event log of every session derived from its ticks, written with decoded types and read back."""
    events = event_log.event_rows(W.seen_ticks(W.telemetry(spark, sf_dir)), chunk_ticks=EVENT_CHUNK_TICKS)
    path = new_shared_path(spark, "events")
    tables.write_events(events, path)
    back = documents.read_session_table(spark, path, T.StructType([
        T.StructField("tick", T.IntegerType()), T.StructField("event_type", T.StringType()), T.StructField("item_name", T.StringType()),
        T.StructField("count", T.ShortType()), T.StructField("prev_count", T.ShortType())]), whole=True)
    return back.select("session_id", "tick", "event_type", "item_name", *[F.col(c).cast("int").alias(c) for c in ("count", "prev_count")])
