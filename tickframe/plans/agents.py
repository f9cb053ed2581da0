"""Agent actions and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import agents
from tickframe.plans import workload as W
from tickframe.plans.registry import query
from tickframe.schemas import OBSERVATION
from tickframe.sinks.shared import new_shared_path
from tickframe.sources import documents

_T = f"WITH {W.TELEMETRY_SQL}"
_HELD = f"""{_T},
swept AS (SELECT session_id AS connection_id, ord AS "at", event_id, event_type,
  last_value(CASE WHEN event_type = 'click' THEN ord END IGNORE NULLS) OVER w AS action_at,
  last_value(CASE WHEN event_type = 'click' THEN k END IGNORE NULLS) OVER w AS k,
  last_value(CASE WHEN event_type <> 'click' THEN ord END IGNORE NULLS) OVER (
    PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tick_before
  FROM tele WINDOW w AS (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT connection_id, "at", event_id, action_at, k FROM swept WHERE event_type <> 'click'"""


def _hold(spark, sf_dir, **options):
    """Clicks are actions, every other row is a tick."""
    tele = W.telemetry(spark, sf_dir).withColumnsRenamed({"session_id": "connection_id", "ord": "at"})
    clicks = tele.where(F.col("event_type") == "click").select("connection_id", "at", "k")
    ticks = tele.where(F.col("event_type") != "click").select("connection_id", "at", "event_id")
    return agents.hold_last(ticks, clicks, ["k"], **options)


@query("action_hold", _HELD)
def action_hold(spark, sf_dir):
    return _hold(spark, sf_dir)


@query("action_lock_step", f"{_HELD} AND action_at > coalesce(tick_before, -1)")
def action_lock_step(spark, sf_dir):
    return _hold(spark, sf_dir, lock_step=True)


@query("action_ties", f"""{_T},
clicks AS (SELECT session_id, tick AS at, k, ord, row_number() OVER (PARTITION BY session_id, tick ORDER BY ord DESC) AS n
           FROM tele WHERE event_type IN ('click', 'view')),
held AS (SELECT t.session_id, t.tick AS at, max(c.at) AS action_at FROM (SELECT DISTINCT session_id, tick FROM tele) t
         LEFT JOIN clicks c ON c.session_id = t.session_id AND c.at <= t.tick GROUP BY ALL)
SELECT h.session_id, h.at, h.action_at, k FROM held h LEFT JOIN clicks c ON c.session_id = h.session_id AND c.at = h.action_at AND n = 1""")
def action_ties(spark, sf_dir):
    """Two actions may come in one tick: the one that arrived last is held."""
    tele = W.telemetry(spark, sf_dir)
    ticks = tele.select("session_id", F.col("tick").alias("at")).distinct()
    clicks = tele.where(F.col("event_type").isin("click", "view")).select("session_id", F.col("tick").alias("at"), "k", "ord")
    return agents.hold_last(ticks, clicks, ["k"], keys=["session_id"], arrival="ord")


def _turns(spark, sf_dir):
    delta = (F.col("k") * 3 - 150).cast("double")
    return W.telemetry(spark, sf_dir).select(
        "session_id", "ord", delta.alias("delta_yaw"), (delta / 2).alias("delta_pitch"))


@query("camera_yaw", f"""{_T} SELECT session_id, ord, 90.0 + sum(CAST(k * 3 - 150 AS DOUBLE)) OVER (
  PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS yaw FROM tele""")
def camera_yaw(spark, sf_dir):
    turned = agents.camera_yaw(_turns(spark, sf_dir), 90.0, order="ord")
    return turned.select("session_id", "ord", "yaw")


@query("camera_pitch", f"""WITH RECURSIVE {W.TELEMETRY_SQL.strip()},
step(session_id, ord, pitch) AS (
  SELECT session_id, ord, least(greatest((k * 3 - 150) / 2.0 + 10.0, -90.0), 90.0) FROM tele WHERE ord = 0
  UNION ALL
  SELECT t.session_id, t.ord, least(greatest(s.pitch + (t.k * 3 - 150) / 2.0, -90.0), 90.0)
  FROM step s JOIN tele t ON t.session_id = s.session_id AND t.ord = s.ord + 1)
SELECT session_id, ord, CAST(pitch AS DOUBLE) AS pitch FROM step""")
def camera_pitch(spark, sf_dir):
    return agents.camera_pitch(_turns(spark, sf_dir), 10.0, order="ord").select(
        "session_id", "ord", "pitch")


def _messages(spark, sf_dir):
    """Action messages as text; ``error`` rows sent something that is no action."""
    kind = F.col("event_type")
    sent = F.to_json(F.struct(
        F.when(kind == "click", True).alias("forward"), F.when(F.col("k") % 2 == 0, False).alias("jump"),
        F.when(kind == "view", F.col("k") % 9).alias("inventory_slot"),
        (F.col("k") * 3 - 150).alias("delta_yaw")))
    return W.telemetry(spark, sf_dir).select(
        "event_id", F.when(kind == "error", F.concat(F.lit("oops "), sent)).otherwise(sent).alias("message"))


@query("actions_parsed", f"""{_T} SELECT event_id, event_type = 'click' AS forward, false AS jump,
false AS use, CASE WHEN event_type = 'view' THEN k % 9 ELSE -1 END AS inventory_slot,
CAST(k * 3 - 150 AS DOUBLE) AS delta_yaw, CAST(0 AS DOUBLE) AS delta_pitch
FROM tele WHERE event_type <> 'error'""")
def actions_parsed(spark, sf_dir):
    good, _ = documents.parse_actions(_messages(spark, sf_dir), "message")
    return good.select("event_id", "forward", "jump", "use", "inventory_slot",
                       *[F.col(c).cast("double").alias(c) for c in ("delta_yaw", "delta_pitch")])


@query("actions_rejected", f"{_T} SELECT event_id FROM tele WHERE event_type = 'error'")
def actions_rejected(spark, sf_dir):
    _, bad = documents.parse_actions(_messages(spark, sf_dir), "message")
    return bad.select("event_id")


@query("observations", f"""{_T},
slots AS (SELECT event_id, 0 AS slot, {W.ITEM_SQL} AS item, 1 + k % 4 AS count FROM tele WHERE k % 3 > 0
          UNION ALL SELECT event_id, 5, 'torch', k FROM tele WHERE k % 3 > 1)
SELECT event_id AS tick, round(value, 6) AS x, k % 20 AS food, k % 10 <> 0 AS alive,
  {W.DIMENSION_SQL} AS dimension, slot, item, count
FROM tele LEFT JOIN slots USING (event_id)""")
def observations(spark, sf_dir):
    """Observation messages written as JSON Lines and read back, one row per stack."""
    def stack(slot, item, count):
        return F.struct(F.lit(slot).alias("slot"), item.alias("id"), count.alias("count"))

    inventory = F.array_compact(F.array(
        F.when(F.col("k") % 3 > 0, stack(0, W.name_by_k(W.ITEMS), 1 + F.col("k") % 4)),
        F.when(F.col("k") % 3 > 1, stack(5, F.lit("torch"), F.col("k")))))
    given = {"x": F.round("value", 6), "food": F.col("k") % 20, "alive": F.col("k") % 10 != 0,
             "inventory": inventory, "dimension": W.name_by_k(W.DIMENSIONS), "tick": F.col("event_id"),
             "reward": F.lit(0.0), "done": F.lit(False)}
    path = new_shared_path(spark, "observations")
    (W.telemetry(spark, sf_dir)
     .select(*[given[f.name].alias(f.name) for f in OBSERVATION if f.name in given]).write.json(path))
    return documents.observation_items(documents.read_observations(spark, path)).select(
        "tick", "x", "food", "alive", "dimension", "slot", "item", "count")
