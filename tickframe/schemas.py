"""Declared schemas and the fixed value tables of the telemetry formats."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_INT, _LONG, _SHORT, _BYTE = T.IntegerType(), T.LongType(), T.ShortType(), T.ByteType()
_FLOAT, _DOUBLE, _STR, _BOOL = T.FloatType(), T.DoubleType(), T.StringType(), T.BooleanType()

# --- binary logs -----------------------------------------------------------

TICKS = _struct(
    ("tick", _INT), ("timestamp_ms", _LONG),
    ("player_x", _FLOAT), ("player_y", _FLOAT), ("player_z", _FLOAT),
    ("player_yaw", _FLOAT), ("player_pitch", _FLOAT), ("health", _FLOAT),
    ("hunger", _INT), ("xp", _INT), ("biome_id", _SHORT),
    ("light_level", _BYTE), ("is_raining", _BYTE), ("time_of_day", _INT),
    ("key_mask", _INT), ("yaw_delta", _FLOAT), ("pitch_delta", _FLOAT),
    ("dimension", _BYTE), ("player_pose", _BYTE), ("_padding", _SHORT),
)

EVENTS = _struct(
    ("tick", _INT), ("event_type", _SHORT), ("item_name", _STR),
    ("count", _SHORT), ("prev_count", _SHORT),
)

CAPTURE_TICKS = _struct(
    ("tick", _LONG), ("recorded_tick", _LONG), ("record_size", _INT),
    ("flags", _INT), ("hotbar", _SHORT), ("mouse_btn", _SHORT),
    ("yaw_fp", _SHORT), ("pitch_fp", _SHORT),
    ("x", _FLOAT), ("y", _FLOAT), ("z", _FLOAT), ("health", _FLOAT),
    ("food", _SHORT), ("screen_type", _SHORT), ("xp_level", _INT),
    ("vel_x", _FLOAT), ("vel_y", _FLOAT), ("vel_z", _FLOAT),
    ("cursor_x", _SHORT), ("cursor_y", _SHORT),
)

PACKETS = _struct(
    ("pos", _LONG), ("tick", _LONG), ("timestamp_ms", _LONG),
    ("packet_id", _INT), ("data_len", _LONG), ("data", T.BinaryType()),
)

# Byte layouts of the fixed-size records (fixed values of the formats).
TICK_RECORD_BYTES = 68
CAPTURE_HEADER_BYTES = 25
CAPTURE_RECORD_BYTES = 48
OLD_CAPTURE_RECORD_BYTES = 28
CAPTURE_MAGIC = b"MCAP"
CAPTURE_CODEC_LZ4 = 1
EVENT_HEADER_BYTES = 6
EVENT_TAIL_BYTES = 4
PACKET_HEADER_BYTES_V1 = 8
PACKET_HEADER_BYTES_V2 = 14
NAME_LIMIT_BYTES = 255

# --- JSON documents --------------------------------------------------------

SESSION_MANIFEST = _struct(
    ("schema_version", _INT), ("mc_version", _STR), ("yarn", _STR),
    ("session_id", _STR), ("player_uuid", _STR), ("seed", _LONG),
    ("game_mode", _STR), ("status", _STR),
)

CHUNK_MANIFEST = _struct(
    ("session_id", _STR), ("chunk_index", _INT), ("start_tick", _INT), ("end_tick", _INT),
    ("start_time_ms", _LONG), ("end_time_ms", _LONG), ("uploaded", _BOOL),
)

SESSION_LEDGER = _struct(
    ("session_id", _STR), ("player_id", _STR), ("started_at_ms", _LONG),
    ("ended_at_ms", _LONG), ("total_chunks", _INT),
    ("chunks", T.ArrayType(_struct(
        ("index", _INT), ("start_tick", _INT), ("end_tick", _INT), ("uploaded", _BOOL)))),
)

OBSERVATION = _struct(
    ("x", _DOUBLE), ("y", _DOUBLE), ("z", _DOUBLE),
    ("yaw", _FLOAT), ("pitch", _FLOAT), ("health", _FLOAT), ("food", _INT),
    ("alive", _BOOL), ("on_ground", _BOOL),
    ("inventory", T.ArrayType(_struct(("slot", _INT), ("id", _STR), ("count", _INT)))),
    ("hotbar_slot", _INT), ("dimension", _STR), ("tick", _LONG),
    ("reward", _DOUBLE), ("done", _BOOL),
)

ACTION_KEYS = ("forward", "back", "left", "right", "jump", "sneak", "sprint",
               "attack", "use", "drop")
ACTION = _struct(
    *((name, _BOOL) for name in ACTION_KEYS),
    ("inventory_slot", _INT), ("delta_yaw", _FLOAT), ("delta_pitch", _FLOAT),
)
# Value of a field an action message leaves out.
ACTION_DEFAULTS = {**{name: False for name in ACTION_KEYS},
                   "inventory_slot": -1, "delta_yaw": 0.0, "delta_pitch": 0.0}

# --- tracker stream and run summary ---------------------------------------

TRACKER = _struct(
    ("session_id", _STR), ("player_id", _STR), ("tick", _LONG), ("rank", _INT),
    ("kind", _STR), ("name", _STR), ("delta", _INT),
)

# A tick as it was seen, before anything is derived from it. ``happened`` holds what hooks reported during the
# tick, in order: STATUS (an entity's type and status code), PLACED, ADVANCEMENT, TRADE.
OBSERVED = _struct(
    ("session_id", _STR), ("player_id", _STR), ("tick", _LONG), ("dimension", _STR), ("alive", _BOOL),
    ("inventory", T.ArrayType(_struct(("slot", _INT), ("item", _STR), ("count", _INT)))),
    ("happened", T.ArrayType(_struct(("kind", _STR), ("name", _STR), ("delta", _INT)))),
)
# A tick with all that the event log is derived from. ``equipment`` lists the slots that hold something, ``bars`` the
# boss bars on the screen; ``happened`` may hold CRAFTED (item, count) too.
SEEN = _struct(
    *[(f.name, f.dataType) for f in OBSERVED], ("sleeping", _BOOL),
    ("equipment", T.ArrayType(_struct(("slot", _INT), ("item", _STR), ("enchanted", _BOOL), ("count", _INT)))),
    ("bars", T.ArrayType(_struct(("name", _STR), ("percent", _DOUBLE)))),
)
# Equipment slots by number, as the event log names them in lower case.
EQUIPMENT_SLOTS = ("MAINHAND", "OFFHAND", "FEET", "LEGS", "CHEST", "HEAD")
ENTITY_DIED = 3
# Room for the calls of one tick in a session's call numbers.
CALLS_PER_TICK = 1 << 20

# Order of the calls within one tick: the tick itself is counted in the phase
# it began in, then the dimension change, then everything else.
RANK_TICK, RANK_DIMENSION, RANK_OTHER = 0, 1, 2
RANKS_PER_TICK = 8

RUN_SUMMARY = _struct(
    ("run_id", _STR), ("session_id", _STR), ("player_id", _STR), ("category", _STR),
    ("completed", _BOOL), ("outcome", _STR), ("started_at_ms", _LONG),
    ("duration_ticks", _LONG), ("overworld_ticks", _LONG), ("nether_ticks", _LONG),
    ("end_ticks", _LONG), ("portal_build_tick", _LONG), ("fortress_enter_tick", _LONG),
    ("bastion_enter_tick", _LONG), ("stronghold_enter_tick", _LONG),
    ("blind_travel_tick", _LONG), ("eye_spy_tick", _LONG), ("dragon_enter_tick", _LONG),
    ("kill_tick", _LONG), ("blaze_rods_used", _INT), ("blaze_rods_collected", _INT),
    ("blaze_kills", _INT), ("pearls_used", _INT), ("beds_used", _INT),
    ("gold_traded", _INT), ("deaths", _INT), ("efficiency_score", _INT),
    ("nether_score", _INT), ("seed_quality", _INT), ("mod_version", _STR),
)

# --- code tables (fixed values of the formats) ------------------------------

EVENT_TYPES = {
    0: "INVENTORY_DELTA", 1: "CRAFTED", 2: "PLAYER_DIED", 3: "SLEPT",
    4: "DIMENSION_CHANGE", 5: "DRAGON_HEALTH", 6: "EQUIPMENT_CHANGE", 7: "ADVANCEMENT",
}

PACKET_NAMES = {
    1: "ScreenHandlerSlotUpdate", 2: "Inventory", 3: "OpenScreen", 4: "CloseScreen",
    5: "PlayerPositionLook", 6: "EntityPosition", 7: "BlockUpdate", 8: "HeldItemChange",
}

DIMENSION_CODES = {"minecraft:overworld": 0, "minecraft:the_nether": 1, "minecraft:the_end": 2}
PHASE_NAMES = ("OVERWORLD", "NETHER", "END")

FLAG_NAMES = ("forward", "back", "left", "right", "jump", "sneak", "sprint", "screen_open",
              "arm_swing", "attack", "use", "on_ground", "in_water")
FLAG_LETTERS = "WSADJCRIHKUG~"
MOUSE_NAMES = ("left", "right", "middle")
KEY_NAMES = ("forward", "back", "left", "right", "jump", "sneak", "sprint")

# Advancement id -> milestone column it stamps.
MILESTONE_ADVANCEMENTS = {
    "minecraft:nether/find_bastion": "bastion_enter_tick",
    "minecraft:nether/find_fortress": "fortress_enter_tick",
    "minecraft:story/follow_ender_eye": "eye_spy_tick",
    "minecraft:nether/fast_travel": "blind_travel_tick",
}

UPLOAD_FILES = ("tick_stream.parquet", "events.parquet", "manifest.json")

CHUNK_TICKS = 6000          # current format: five minutes at 20 ticks per second
CAPTURE_CHUNK_TICKS = 400   # older capture format
POSITION_ALERT_BLOCKS = 5.0
