"""Inventory snapshots and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import inventory
from tickframe.plans import workload as W
from tickframe.plans.registry import query

RESET_TICKS = 8

_SNAP = f"""WITH {W.TELEMETRY_SQL},
slots AS (SELECT session_id, tick, ord % 2 AS slot, {W.ITEM_SQL} AS item, 1 + k % 4 AS count
          FROM tele WHERE event_type = 'purchase'),
totals AS (SELECT session_id, tick, item, CAST(sum(count) AS BIGINT) AS count FROM slots GROUP BY ALL),
ends AS (SELECT session_id, max(tick) AS last_tick FROM tele GROUP BY ALL)"""


def _deltas_sql(reset: str) -> str:
    return f"""{_SNAP},
before AS (SELECT t.session_id, t.tick + 1 AS tick, item, count FROM totals t JOIN ends USING (session_id)
           WHERE t.tick + 1 <= last_tick {reset}),
deltas AS (
  SELECT session_id, tick, item, coalesce(c.count, 0) AS count, coalesce(p.count, 0) AS prev_count
  FROM totals c FULL JOIN before p USING (session_id, tick, item)
  WHERE coalesce(c.count, 0) <> coalesce(p.count, 0))"""


_PLAIN = _deltas_sql("")
_RESET = _deltas_sql(f"AND (t.tick + 1) % {RESET_TICKS} <> 0")
_OUT = "SELECT session_id, tick, item, count, prev_count, count - prev_count AS delta FROM deltas"


def _slots(spark, sf_dir):
    return (W.telemetry(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        "session_id", "tick", (F.col("ord") % 2).cast("int").alias("slot"),
        W.name_by_k(W.ITEMS).alias("item"), (1 + F.col("k") % 4).alias("count")))


def _deltas(spark, sf_dir, **options):
    return inventory.item_deltas(inventory.item_totals(_slots(spark, sf_dir)),
                                 W.telemetry(spark, sf_dir), **options)


@query("inventory_totals", f"{_SNAP} SELECT * FROM totals")
def inventory_totals(spark, sf_dir):
    return inventory.item_totals(_slots(spark, sf_dir))


@query("inventory_lists", f"""{_SNAP}
SELECT session_id, tick, string_agg(slot || ':' || item || ':' || count, ',' ORDER BY slot) AS inventory
FROM slots GROUP BY ALL""")
def inventory_lists(spark, sf_dir):
    text = F.transform("inventory", lambda s: F.concat_ws(":", s["slot"], s["item"], s["count"]))
    return inventory.slot_lists(_slots(spark, sf_dir)).withColumn(
        "inventory", F.array_join(text, ","))


@query("inventory_deltas", f"{_PLAIN} {_OUT}")
def inventory_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query("inventory_deltas_chunked", f"{_RESET} {_OUT}")
def inventory_deltas_chunked(spark, sf_dir):
    """As the event log stores them: every chunk starts from an empty snapshot."""
    return _deltas(spark, sf_dir, reset_every=RESET_TICKS)


# Snapshots of the ticks with a purchase or an error, of which the latter are empty: all other ticks are holes.
_HOLES = f"""{_SNAP},
seen AS (SELECT session_id, tick, lag(tick) OVER (PARTITION BY session_id ORDER BY tick) AS was,
                lead(tick) OVER (PARTITION BY session_id ORDER BY tick) AS next_tick
         FROM (SELECT DISTINCT session_id, tick FROM tele WHERE event_type IN ('purchase', 'error'))),
before AS (SELECT session_id, next_tick AS tick, item, count FROM totals JOIN seen USING (session_id, tick) WHERE next_tick IS NOT NULL),
deltas AS (
  SELECT session_id, tick, item, coalesce(c.count, 0) AS count, coalesce(p.count, 0) AS prev_count
  FROM totals c FULL JOIN before p USING (session_id, tick, item)
  WHERE coalesce(c.count, 0) <> coalesce(p.count, 0))"""


@query("inventory_deltas_observed", f"{_HOLES} {_OUT}")
def inventory_deltas_observed(spark, sf_dir):
    """Deltas of sessions whose snapshots have holes."""
    seen = W.telemetry(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).select("session_id", "tick")
    return inventory.observed_deltas(inventory.item_totals(_slots(spark, sf_dir)), seen)


@query("inventory_repair", f"""{_RESET},
seen AS (SELECT session_id, tick, item, count, coalesce(lag(count) OVER (
           PARTITION BY session_id, item ORDER BY tick), 0) AS prev_count FROM deltas)
SELECT session_id, tick, item, count, prev_count, count - prev_count AS delta
FROM seen WHERE count <> prev_count""")
def inventory_repair(spark, sf_dir):
    return inventory.repair_deltas(_deltas(spark, sf_dir, reset_every=RESET_TICKS))
