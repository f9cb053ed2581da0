"""Code tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickframe.schemas import (DIMENSION_CODES, EVENT_TYPES, MILESTONE_ADVANCEMENTS,
                               PACKET_NAMES, PHASE_NAMES)


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def packet_name(packet_id: Column) -> Column:
    return F.coalesce(_lookup(PACKET_NAMES, packet_id.cast("int")), F.lit("Unknown"))


def event_label(code: Column, mode: str = "full") -> Column:
    """Event code to label; a code outside the table fails the query.

    ``full`` knows all eight types, ``strict_v1`` only the first four, which is
    what the converter of the format knows.
    """
    last = {"full": 7, "strict_v1": 3}[mode]
    table = {k: v for k, v in EVENT_TYPES.items() if k <= last}
    code = code.cast("int")
    unknown = F.raise_error(F.concat(F.lit("unknown event type "), code.cast("string")))
    return F.when(code.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(_lookup(table, code), unknown))


def dimension_code(dimension: Column) -> Column:
    """0, 1, 2 or -1 for a dimension the format does not know."""
    return F.coalesce(_lookup(DIMENSION_CODES, dimension), F.lit(-1)).cast("tinyint")


def phase_code(dimension: Column) -> Column:
    """Index into ``PHASE_NAMES``; an unknown dimension is the overworld, null stays null."""
    return (F.when(dimension.isNull(), F.lit(None))
            .when(dimension == "minecraft:the_nether", F.lit(1))
            .when(dimension == "minecraft:the_end", F.lit(2))
            .otherwise(F.lit(0)).cast("tinyint"))


def phase_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHASE_NAMES]), code.cast("int") + 1)


def phase(dimension: Column) -> Column:
    return phase_name(F.coalesce(phase_code(dimension), F.lit(0)))


def pose(*, gliding: Column, sleeping: Column, swimming: Column, crawling: Column,
         sneaking: Column) -> Column:
    """First pose that holds, strongest first; standing when none does."""
    return (F.when(gliding, 5).when(sleeping, 4).when(swimming, 2)
            .when(crawling, 3).when(sneaking, 1).otherwise(0).cast("tinyint"))


def qualify_item(path: Column) -> Column:
    return F.concat(F.lit("minecraft:"), path)


def bare_item(item: Column) -> Column:
    return F.regexp_replace(item, "^minecraft:", "")


def is_milestone_advancement(advancement: Column) -> Column:
    return advancement.isin(*MILESTONE_ADVANCEMENTS)


def name_contains(name: Column, part: str) -> Column:
    """Case-insensitive containment."""
    return F.contains(F.lower(name), F.lit(part.lower()))


def admission(*, player: Column, creative: Column, spectator: Column,
              screen_open: Column) -> Column:
    """Gate verdict of one tick."""
    return (F.when(~player, "DENY_TRANSIENT")
            .when(creative | spectator, "DENY_PERMANENT")
            .when(screen_open, "DENY_TRANSIENT")
            .otherwise("ALLOW"))


def record_size(payload_bytes: Column) -> Column:
    """Capture record size guessed from divisibility; 48 is tried first and is the default."""
    return F.when(payload_bytes % 48 == 0, 48).when(payload_bytes % 28 == 0, 28).otherwise(48)
