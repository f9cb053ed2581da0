"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import angles, bits, labels, scores, text
from tickframe.operators import admission, agents, runs
from tickframe.plans import workload as W
from tickframe.plans.registry import query
from tickframe.schemas import (EVENT_TYPES, FLAG_LETTERS, FLAG_NAMES, KEY_NAMES, MOUSE_NAMES)

_FLAGS = "(l_orderkey % 8192)"
_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_KEY_SQL = ", ".join(_KEY)


def _lineitem(spark, sf_dir):
    return W.table(spark, sf_dir, "lineitem")


def _bit_sql(word: str, i: int) -> str:
    return f"((({word}) >> {i}) & 1) = 1"


@query("flag_unpack", f"""SELECT {_KEY_SQL},
{", ".join(f'{_bit_sql(_FLAGS, i)} AS "{n}"' for i, n in enumerate(FLAG_NAMES))},
{", ".join(f'{_bit_sql("l_linenumber % 8", i)} AS mouse_{n}' for i, n in enumerate(MOUSE_NAMES))}
FROM lineitem""")
def flag_unpack(spark, sf_dir):
    rows = _lineitem(spark, sf_dir).select(
        *_KEY, bits.unpack_flags(F.col("l_orderkey") % 8192).alias("f"),
        bits.unpack_mouse(F.col("l_linenumber") % 8).alias("m"))
    return rows.select(*_KEY, "f.*", *[F.col(f"m.{n}").alias(f"mouse_{n}") for n in MOUSE_NAMES])


@query("flag_string", "SELECT {}, {} AS flag_text FROM lineitem".format(_KEY_SQL, " || ".join(
    f"CASE WHEN {_bit_sql(_FLAGS, i)} THEN '{c}' ELSE '.' END" for i, c in enumerate(FLAG_LETTERS))))
def flag_string(spark, sf_dir):
    return _lineitem(spark, sf_dir).select(
        *_KEY, bits.flag_string(F.col("l_orderkey") % 8192).alias("flag_text"))


@query("key_mask", f"SELECT {_KEY_SQL}, CAST(l_partkey % 128 AS INTEGER) AS key_mask FROM lineitem")
def key_mask(spark, sf_dir):
    pressed = {n: bits.bit(F.col("l_partkey") % 128, i) for i, n in enumerate(KEY_NAMES)}
    return _lineitem(spark, sf_dir).select(*_KEY, bits.pack_keys(pressed).alias("key_mask"))


@query("key_unpack", f"""SELECT {_KEY_SQL},
{", ".join(f'{_bit_sql("l_partkey % 128", i)} AS "{n}"' for i, n in enumerate(KEY_NAMES))} FROM lineitem""")
def key_unpack(spark, sf_dir):
    rows = _lineitem(spark, sf_dir).select(
        *_KEY, bits.unpack_keys(F.col("l_partkey") % 128).alias("pressed"))
    return rows.select(*_KEY, "pressed.*")


@query("pose", f"""SELECT {_KEY_SQL},
CAST(CASE WHEN {_bit_sql("l_orderkey", 0)} THEN 5 WHEN {_bit_sql("l_orderkey", 1)} THEN 4
     WHEN {_bit_sql("l_orderkey", 2)} THEN 2 WHEN {_bit_sql("l_orderkey", 3)} THEN 3
     WHEN {_bit_sql("l_orderkey", 4)} THEN 1 ELSE 0 END AS INTEGER) AS pose FROM lineitem""")
def pose(spark, sf_dir):
    names = ("gliding", "sleeping", "swimming", "crawling", "sneaking")
    states = {n: bits.bit(F.col("l_orderkey") % 32, i) for i, n in enumerate(names)}
    return _lineitem(spark, sf_dir).select(*_KEY, labels.pose(**states).cast("int").alias("pose"))


@query("angles", f"""SELECT {_KEY_SQL},
CAST(CAST((l_partkey * 37 % 65536 - 32768) / 100.0 AS FLOAT) AS DOUBLE) AS yaw,
l_extendedprice AS x, l_tax AS z FROM lineitem""")
def angle_decode(spark, sf_dir):
    raw = (F.col("l_partkey") * 37 % 65536 - 32768).cast("smallint")
    rows = _lineitem(spark, sf_dir).select(
        *_KEY, angles.decode_fixed(raw).cast("double").alias("yaw"),
        angles.vector(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")).alias("pos"))
    return rows.select(*_KEY, "yaw", F.col("pos")[0].alias("x"), F.col("pos")[2].alias("z"))


def _label_sql(last: int) -> str:
    return f"[{', '.join(repr(EVENT_TYPES[i]) for i in range(last + 1))}][l_orderkey % {last + 1} + 1]"


@query("event_labels", f"""SELECT {_KEY_SQL}, {_label_sql(7)} AS label, {_label_sql(3)} AS label_v1
FROM lineitem""")
def event_labels(spark, sf_dir):
    return _lineitem(spark, sf_dir).select(
        *_KEY, labels.event_label(F.col("l_orderkey") % 8).alias("label"),
        labels.event_label(F.col("l_orderkey") % 4, "strict_v1").alias("label_v1"))


@query("time_of_day", """SELECT o_orderkey, CAST((o_orderkey * 977 - 5000000) % 24000 AS INTEGER) AS time_of_day,
CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_raining FROM orders""")
def time_of_day(spark, sf_dir):
    return W.table(spark, sf_dir, "orders").select(
        "o_orderkey", angles.time_of_day(F.col("o_orderkey") * 977 - 5000000).alias("time_of_day"),
        bits.rain_code(F.col("o_orderstatus") == "F").cast("int").alias("is_raining"))


@query("item_ids", """SELECT p_partkey, 'minecraft:' || replace(p_name, ' ', '_') AS item,
replace(p_name, ' ', '_') AS bare FROM part""")
def item_ids(spark, sf_dir):
    named = W.table(spark, sf_dir, "part").select("p_partkey", labels.qualify_item(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("item"))
    return named.select("*", labels.bare_item(F.col("item")).alias("bare"))


_EQUIPMENT_SLOTS = ("MAINHAND", "OFFHAND", "FEET", "LEGS", "CHEST", "HEAD")


@query("equipment_text", f"""WITH p AS (
SELECT p_partkey, lower({list(_EQUIPMENT_SLOTS)}[p_size % 6 + 1]) AS slot,
  replace(p_name, ' ', '_') AS item, p_size % 2 = 0 AS enchanted FROM part)
SELECT *, slot || ':' || item || CASE WHEN enchanted THEN ':ench' ELSE '' END AS equipment FROM p""")
def equipment_text(spark, sf_dir):
    slot = F.element_at(F.array(*[F.lit(s) for s in _EQUIPMENT_SLOTS]), F.col("p_size") % 6 + 1)
    item = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    built = W.table(spark, sf_dir, "part").select(
        "p_partkey", text.equipment_text(slot, item, F.col("p_size") % 2 == 0).alias("equipment"))
    return (built.select("*", text.parse_equipment(F.col("equipment")).alias("p"))
            .select("p_partkey", "equipment", "p.*"))


@query("boss_health_fixed", """SELECT c_custkey,
CAST(least(greatest(CAST(trunc(c_acctbal / 50 * 100) AS INTEGER), 0), 10000) AS INTEGER) AS health_fixed
FROM customer""")
def boss_health_fixed(spark, sf_dir):
    return W.table(spark, sf_dir, "customer").select(
        "c_custkey", text.boss_health_fixed(F.col("c_acctbal") / 50).alias("health_fixed"))


@query("byte_limit", """WITH n AS (
  SELECT p_partkey, p_partkey % 2 AS odd, p_size * 5 AS n FROM part)
SELECT p_partkey,
  CAST(least(2 * n + odd, 255) AS INTEGER) AS bytes,
  CASE WHEN odd = 1 THEN 'x' || repeat('é', least(n, 127))
       WHEN n > 127 THEN repeat('é', 127) || chr(65533) ELSE repeat('é', n) END AS name
FROM n""")
def byte_limit(spark, sf_dir):
    """Names of two-byte letters; without the leading ``x`` the limit splits a letter."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 1, "x").otherwise(""),
                    F.expr("repeat('é', p_size * 5)"))
    raw = W.table(spark, sf_dir, "part").select("p_partkey", text.limit_bytes(name).alias("raw"))
    return raw.select("p_partkey", F.octet_length("raw").alias("bytes"),
                      text.decode_tolerant(F.col("raw")).alias("name"))


@query("payload_preview", """WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS s FROM part)
SELECT p_partkey, lower(substr(hex(encode(s)), 1, 64)) || CASE WHEN strlen(s) > 32 THEN '...' ELSE '' END AS preview
FROM p""")
def payload_preview(spark, sf_dir):
    data = F.encode(F.concat_ws(" ", "p_name", "p_brand", "p_type"), "UTF-8")
    return W.table(spark, sf_dir, "part").select(
        "p_partkey", text.payload_preview(data).alias("preview"))


_EARNED = f"""WITH {W.TELEMETRY_SQL},
earned AS (SELECT event_id, {W.ADVANCEMENT_SQL} AS advancement FROM tele
           UNION ALL SELECT event_id, 'minecraft:story/root' FROM tele WHERE k % 2 = 0)"""


def _earned(spark, sf_dir):
    root = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("minecraft:story/root"), "ts"))
    own = F.create_map(W.name_by_k(W.ADVANCEMENTS), "ts")
    updates = W.telemetry(spark, sf_dir).select(
        "event_id", F.when(root.isNull(), own).otherwise(F.map_concat(own, root)).alias("earned"))
    return runs.advancement_rows(updates)


@query("advancement_rows", f"{_EARNED} SELECT * FROM earned")
def advancement_rows(spark, sf_dir):
    return _earned(spark, sf_dir)


@query("milestone_advancements", f"""{_EARNED} SELECT * FROM earned
WHERE advancement NOT IN ('minecraft:story/other', 'minecraft:story/root')""")
def milestone_advancements(spark, sf_dir):
    return _earned(spark, sf_dir).where(labels.is_milestone_advancement(F.col("advancement")))


@query("scores", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CAST(least(greatest(100 - 5 * greatest(l_suppkey % 20 - 7, 0) - 2 * greatest(l_partkey % 40 - 12, 0)
  - 10 * (l_linenumber % 4), 0), 100) AS INTEGER) AS efficiency_score,
CAST(CASE WHEN l_orderkey > 0 THEN least(greatest(100 - (l_orderkey - 2880) // 144, 0), 100) ELSE -1 END AS INTEGER) AS nether_score
FROM lineitem""")
def run_scores(spark, sf_dir):
    return _lineitem(spark, sf_dir).select(
        *_KEY,
        scores.efficiency_score(F.col("l_suppkey") % 20, F.col("l_partkey") % 40,
                                F.col("l_linenumber") % 4).alias("efficiency_score"),
        scores.nether_score(F.col("l_orderkey")).alias("nether_score"))


@query("movement_axes", f"""SELECT {_KEY_SQL},
CAST(CAST({_bit_sql("l_partkey", 0)} AS INTEGER) - CAST({_bit_sql("l_partkey", 1)} AS INTEGER) AS DOUBLE) AS movement_forward,
CAST(CAST({_bit_sql("l_partkey", 2)} AS INTEGER) - CAST({_bit_sql("l_partkey", 3)} AS INTEGER) AS DOUBLE) AS movement_sideways
FROM lineitem""")
def movement_axes(spark, sf_dir):
    pressed = _lineitem(spark, sf_dir).select(*_KEY, *[
        bits.bit(F.col("l_partkey") % 128, i).alias(n) for i, n in enumerate(KEY_NAMES[:4])])
    return agents.movement(pressed).select(
        *_KEY, *[F.col(c).cast("double").alias(c) for c in ("movement_forward", "movement_sideways")])


_GATE = f"""WITH {W.TELEMETRY_SQL},
gate AS (SELECT session_id, ord AS tick, CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'DENY_TRANSIENT'
    WHEN event_type = 'signup' THEN 'DENY_PERMANENT' WHEN event_type = 'error' THEN 'DENY_TRANSIENT'
    ELSE 'ALLOW' END AS verdict FROM tele),
starts AS (SELECT session_id, min(tick) AS start_tick, arg_min(verdict, tick) AS verdict FROM gate
           WHERE verdict <> 'DENY_TRANSIENT' GROUP BY ALL)"""


def _gate(spark, sf_dir):
    kind = F.col("event_type")
    verdict = labels.admission(
        player=~((kind == "view") & (F.col("k") % 2 == 0)), creative=kind == "signup",
        spectator=F.lit(False), screen_open=kind == "error")
    return W.telemetry(spark, sf_dir).select(
        "session_id", F.col("ord").alias("tick"), verdict.alias("verdict"))


@query("admission", f"""{_GATE} SELECT session_id, start_tick, starts.verdict
FROM (SELECT DISTINCT session_id FROM gate) LEFT JOIN starts USING (session_id)""")
def session_admission(spark, sf_dir):
    return admission.session_starts(_gate(spark, sf_dir))


@query("admitted_ticks", f"""{_GATE} SELECT session_id, tick, gate.verdict FROM gate JOIN starts USING (session_id)
WHERE starts.verdict = 'ALLOW' AND tick >= start_tick""")
def admitted_ticks(spark, sf_dir):
    return admission.admitted_ticks(_gate(spark, sf_dir))
