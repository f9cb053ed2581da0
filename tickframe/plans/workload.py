"""The driver's tables read as session telemetry.

A user of ``events`` is a session, two of their rows in time order share a tick, and
the event type with the number ``k`` of its properties says what happened. One row
stands for 600 game ticks, so that phase times reach the scale the scores are made for.
The SQL fragments state the same mapping for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators import edges, segments, tracker
from tickframe.operators.ordinals import number_rows
from tickframe.schemas import SEEN
from tickframe.sources.sizing import size_shuffles

TICKS_PER_ROW = 600
MOD_VERSION = "0.1.0"

_telemetry: dict[str, tuple[SparkSession, DataFrame]] = {}
_sized: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if _sized.get(sf_dir) is not spark:
        size_shuffles(spark, sf_dir)
        _sized[sf_dir] = spark
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers the rows of every session and writes them, like an ingest of raw logs."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), "event_id", "ts", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    numbered = number_rows(rows, ["session_id"], ["ts", "event_id"], "ord")
    return numbered.withColumn("tick", F.call_function("div", F.col("ord"), F.lit(2)))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested once per session of Spark and folder; queries share the written rows."""
    held = _telemetry.get(sf_dir)
    if held is None or held[0] is not spark:
        held = _telemetry[sf_dir] = (spark, read_telemetry(spark, sf_dir))
    return held[1]


TELEMETRY_SQL = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord
  FROM events),
tele AS (SELECT *, ord // 2 AS tick FROM ev)"""


def player_id(session_id: Column) -> Column:
    return F.concat(F.lit("player-"), session_id)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def name_by_k(names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") % len(names) + 1)


DIMENSIONS = ("minecraft:overworld", "minecraft:the_nether", "minecraft:the_end")
ITEMS = ("blaze_rod", "ender_pearl", "gold_ingot")
ADVANCEMENTS = ("minecraft:nether/find_bastion", "minecraft:nether/find_fortress",
                "minecraft:story/follow_ender_eye", "minecraft:nether/fast_travel",
                "minecraft:story/other")


def _list_sql(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][k % {len(names)} + 1]"


DIMENSION_SQL, ITEM_SQL, ADVANCEMENT_SQL = map(_list_sql, (DIMENSIONS, ITEMS, ADVANCEMENTS))


def dimension_observations(tele: DataFrame) -> DataFrame:
    """Dimension seen per tick; the last signup of a tick by event id wins."""
    seen = segments.add_segment(tele.where(F.col("event_type") == "signup"), "tick")
    w = segments.segment_window(["session_id"], ["tick", "event_id"])
    last = F.lead("tick").over(w).isNull() | (F.lead("tick").over(w) != F.col("tick"))
    return (seen.withColumn("_last", last).where("_last")
            .select("session_id", segments.SEGMENT, "tick", "ts", "event_id",
                    name_by_k(DIMENSIONS).alias("dimension")))


def dimension_changes(tele: DataFrame) -> DataFrame:
    return edges.dimension_changes(dimension_observations(tele))


CHANGES_SQL = f"""
dims AS (
  SELECT session_id, tick, arg_max({DIMENSION_SQL}, event_id) AS dimension
  FROM tele WHERE event_type = 'signup' GROUP BY ALL),
changes AS (
  SELECT session_id, tick, dimension FROM (
    SELECT *, lag(dimension) OVER (PARTITION BY session_id ORDER BY tick) AS was FROM dims)
  WHERE was IS NOT NULL AND was <> dimension)"""


# Items of a tick's inventory: its purchases, in slots; a slot with no items is empty. Ticks without a purchase
# do not show their inventory.
_SLOT = "named_struct('slot', cast(ord % 2 AS int), 'item', element_at(array({items}), k % 3 + 1), 'count', cast(k % 9 AS int))"
_DIED = "event_type = 'error' AND k % 10 = 0"
# What hooks report. Status 3 of an entity is its death; other statuses and unknown entities count for nothing.
_REPORTED = f"""CASE
  WHEN event_type = 'click' AND k % 50 = 0 THEN named_struct('kind', 'STATUS', 'name', 'minecraft:ender_dragon', 'delta', 3)
  WHEN event_type = 'click' AND k % 5 < 2 THEN named_struct('kind', 'STATUS', 'name', 'minecraft:blaze', 'delta', 3)
  WHEN event_type = 'click' AND k % 5 = 2 THEN named_struct('kind', 'PLACED', 'name', 'minecraft:white_bed', 'delta', CAST(NULL AS INT))
  WHEN event_type = 'click' AND k % 5 = 3 THEN named_struct('kind', 'PLACED', 'name', 'minecraft:stone', 'delta', CAST(NULL AS INT))
  WHEN event_type = 'click' AND k % 2 = 0 THEN named_struct('kind', 'STATUS', 'name', 'minecraft:blaze', 'delta', 2)
  WHEN event_type = 'click' THEN named_struct('kind', 'STATUS', 'name', CAST(NULL AS STRING), 'delta', 3)
  WHEN event_type = 'view' THEN named_struct('kind', 'ADVANCEMENT', 'name', element_at(array({{advancements}}), k % 5 + 1), 'delta', CAST(NULL AS INT))
  END"""


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def observed_ticks(tele: DataFrame) -> DataFrame:
    """Ticks as a recorder sees them (``schemas.OBSERVED``), with the time of the tick.

    Partitioned by segment already, and grouped within it, so the tracker's windows add no shuffle.
    """
    dealt = segments.add_segment(tele.select("session_id", "tick", "ts", "event_id", "ord", "event_type", "k"), "tick")
    dealt = dealt.repartition("session_id", segments.SEGMENT)
    slot = _SLOT.format(items=_listed(ITEMS))
    ticks = dealt.groupBy("session_id", segments.SEGMENT, "tick").agg(
        F.max_by(name_by_k(DIMENSIONS), F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("dimension"),
        F.expr(f"NOT bool_or({_DIED})").alias("alive"),
        # At most two rows have one tick here.
        F.array_sort(F.collect_list(F.expr(f"IF(event_type = 'purchase', {slot}, NULL)"))).alias("inventory"),
        F.array_sort(F.collect_list(F.expr(
            f"IF(({_REPORTED.format(advancements=_listed(ADVANCEMENTS))}) IS NULL, NULL, named_struct('ord', ord, "
            f"'call', {_REPORTED.format(advancements=_listed(ADVANCEMENTS))}))"))).alias("reported"),
        F.max("ts").alias("ts"))
    return ticks.select(
        "session_id", player_id(F.col("session_id")).alias("player_id"), "tick", "dimension", "alive",
        F.when(F.size("inventory") > 0, F.col("inventory")).alias("inventory"),
        F.transform("reported", lambda r: r["call"]).alias("happened"), "ts", segments.SEGMENT)


# What the event log needs besides: equipment shows in ticks with a click, every row of which fills or empties one of
# its own slots; bars of view rows are the dragon's.
_STACK = ("IF(event_type = 'click' AND k % 7 > 0, named_struct('slot', cast(ord % 2 * 3 + k % 3 AS int), 'item', concat('item_', cast(k % 5 AS string)), "
          "'enchanted', k % 2 = 0, 'count', cast(1 + k % 3 AS int)), NULL)")
_BAR = ("IF(event_type IN ('view', 'error'), named_struct('ord', ord, 'bar', named_struct('name', "
        "IF(event_type = 'view', 'the ENDER dragon', 'Wither'), 'percent', round(value, 0) / 100)), NULL)")


def seen_ticks(tele: DataFrame) -> DataFrame:
    """``observed_ticks`` with sleep, equipment and boss bars (``schemas.SEEN``)."""
    dealt = segments.add_segment(tele.select("session_id", "tick", "ord", "event_type", "k", "value"), "tick")
    more = dealt.groupBy("session_id", "tick").agg(
        F.expr("bool_or(event_type = 'view' AND k % 4 = 0)").alias("sleeping"),
        F.expr(f"IF(bool_or(event_type = 'click'), array_sort(collect_list({_STACK})), NULL)").alias("equipment"),
        F.transform(F.array_sort(F.expr(f"collect_list({_BAR})")), lambda b: b["bar"]).alias("bars"))
    return observed_ticks(tele).drop("ts", segments.SEGMENT).join(more, ["session_id", "tick"]).select(*SEEN.names)


def tracker_stream(tele: DataFrame, width: int | None = None) -> DataFrame:
    """Tracker calls derived from the observed ticks of every session, with ``call_no``, ``ts`` and their segment."""
    return tracker.tracker_calls(observed_ticks(tele), width, segmented=True)


def sessions(tele: DataFrame) -> DataFrame:
    """Start time and client version per session, as a session manifest would give them."""
    return tele.groupBy("session_id").agg(
        epoch_ms(F.min("ts")).alias("started_at_ms"),
        F.lit(MOD_VERSION).alias("mod_version"))


STREAM_SQL = f"""{TELEMETRY_SQL},{CHANGES_SQL},
deaths AS (
  SELECT session_id, tick FROM (
    SELECT *, lag(dead, 1, false) OVER (PARTITION BY session_id ORDER BY tick) AS was
    FROM (SELECT session_id, tick, bool_or(event_type = 'error' AND k % 10 = 0) AS dead FROM tele GROUP BY ALL))
  WHERE dead AND NOT was),
shown AS (SELECT session_id, tick, lead(tick) OVER (PARTITION BY session_id ORDER BY tick) AS next_tick
          FROM (SELECT DISTINCT session_id, tick FROM tele WHERE event_type = 'purchase')),
held AS (SELECT session_id, tick, {ITEM_SQL} AS item, sum(k % 9) AS count
         FROM tele WHERE event_type = 'purchase' GROUP BY ALL),
gains AS (
  SELECT session_id, tick, item, CAST(sum(count) AS INTEGER) AS delta FROM (
    SELECT session_id, tick, item, count FROM held
    UNION ALL SELECT session_id, next_tick, item, -count FROM held JOIN shown USING (session_id, tick)
    WHERE next_tick IS NOT NULL)
  GROUP BY ALL HAVING sum(count) <> 0),
stream AS (
  SELECT session_id, tick, 0 AS rank, 'TICK' AS kind, NULL AS name, NULL AS delta
  FROM tele WHERE ord % 2 = 0
  UNION ALL SELECT session_id, tick, 1, 'DIMENSION', dimension, NULL FROM changes
  UNION ALL SELECT session_id, tick, 2, 'INVENTORY', 'minecraft:' || item, delta FROM gains
  UNION ALL SELECT session_id, tick, 2, 'DIED', NULL, NULL FROM deaths
  UNION ALL SELECT session_id, tick, 2, 'KILLED',
    CASE WHEN k % 50 = 0 THEN 'minecraft:ender_dragon' ELSE 'minecraft:blaze' END, NULL
  FROM tele WHERE event_type = 'click' AND k % 5 < 2
  UNION ALL SELECT session_id, tick, 2, 'PLACED',
    CASE WHEN k % 5 = 2 THEN 'minecraft:white_bed' ELSE 'minecraft:stone' END, NULL
  FROM tele WHERE event_type = 'click' AND k % 5 IN (2, 3)
  UNION ALL SELECT session_id, tick, 2, 'ADVANCEMENT', {ADVANCEMENT_SQL}, NULL
  FROM tele WHERE event_type = 'view'),
phased AS (
  SELECT *, coalesce(last_value(CASE WHEN kind = 'DIMENSION' THEN
      CASE name WHEN 'minecraft:the_nether' THEN 'NETHER' WHEN 'minecraft:the_end' THEN 'END'
                ELSE 'OVERWORLD' END END IGNORE NULLS)
    OVER (PARTITION BY session_id ORDER BY tick, rank ROWS UNBOUNDED PRECEDING), 'OVERWORLD') AS phase
  FROM stream)"""

# Per-row contributions of the counters, over ``phased``.
COUNTERS_SQL = {
    "overworld_ticks": "CASE WHEN kind = 'TICK' AND phase = 'OVERWORLD' THEN 600 ELSE 0 END",
    "nether_ticks": "CASE WHEN kind = 'TICK' AND phase = 'NETHER' THEN 600 ELSE 0 END",
    "end_ticks": "CASE WHEN kind = 'TICK' AND phase = 'END' THEN 600 ELSE 0 END",
    "blaze_rods_used": "CASE WHEN kind = 'INVENTORY' AND name = 'minecraft:blaze_rod' AND delta < 0 THEN -delta ELSE 0 END",
    "blaze_kills": "CASE WHEN kind = 'KILLED' AND name = 'minecraft:blaze' THEN 1 ELSE 0 END",
    "pearls_used": "CASE WHEN kind = 'INVENTORY' AND name = 'minecraft:ender_pearl' AND delta < 0 THEN -delta ELSE 0 END",
    "beds_used": "CASE WHEN kind = 'PLACED' AND phase = 'END' AND name LIKE '%\\_bed' ESCAPE '\\' THEN 1 ELSE 0 END",
    "gold_traded": "CASE WHEN kind = 'INVENTORY' AND phase = 'NETHER' AND name = 'minecraft:gold_ingot' AND delta < 0 THEN -delta ELSE 0 END",
    "deaths": "CASE WHEN kind = 'DIED' THEN 1 ELSE 0 END",
}
STAMPS_SQL = {
    "portal_build_tick": "CASE WHEN kind = 'DIMENSION' AND name = 'minecraft:the_nether' THEN (tick + 1) * 600 END",
    "dragon_enter_tick": "CASE WHEN kind = 'DIMENSION' AND name = 'minecraft:the_end' THEN (tick + 1) * 600 END",
    "bastion_enter_tick": "CASE WHEN name = 'minecraft:nether/find_bastion' THEN (tick + 1) * 600 END",
    "fortress_enter_tick": "CASE WHEN name = 'minecraft:nether/find_fortress' THEN (tick + 1) * 600 END",
    "eye_spy_tick": "CASE WHEN name = 'minecraft:story/follow_ender_eye' THEN (tick + 1) * 600 END",
    "blind_travel_tick": "CASE WHEN name = 'minecraft:nether/fast_travel' THEN (tick + 1) * 600 END",
}
KILL_SQL = "CASE WHEN kind = 'KILLED' AND name = 'minecraft:ender_dragon' THEN (tick + 1) * 600 END"

TOTALS_SQL = f"""{STREAM_SQL},
totals AS (
  SELECT session_id, CAST(count(*) FILTER (kind = 'TICK') * 600 AS BIGINT) AS duration_ticks,
    CAST(sum(CASE WHEN kind = 'INVENTORY' AND name = 'minecraft:blaze_rod' AND delta >= 0 THEN delta ELSE 0 END) AS INTEGER) AS blaze_rods_collected,
    {", ".join(f"CAST(sum({v}) AS {'BIGINT' if n.endswith('_ticks') else 'INTEGER'}) AS {n}" for n, v in COUNTERS_SQL.items())},
    {", ".join(f"coalesce(min({v}), -1) AS {n}" for n, v in STAMPS_SQL.items())},
    coalesce(max({KILL_SQL}), -1) AS kill_tick
  FROM phased GROUP BY session_id)"""

OUTCOME_SQL = "CASE WHEN kill_tick >= 0 THEN 'win' WHEN deaths > 0 THEN 'death' ELSE 'quit' END"
