"""Names, previews and composed text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickframe.schemas import NAME_LIMIT_BYTES

_ENCHANTED = ":ench"


def limit_bytes(text: Column, limit: int = NAME_LIMIT_BYTES) -> Column:
    """Encoded name as the log stores it: at most ``limit`` bytes, cut anywhere."""
    return F.substring(F.encode(text, "UTF-8"), 1, limit)


def decode_tolerant(raw: Column) -> Column:
    """UTF-8 text in which bad bytes become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def equipment_text(slot: Column, item: Column, enchanted: Column) -> Column:
    return F.concat(F.lower(slot), F.lit(":"), item,
                    F.when(enchanted, F.lit(_ENCHANTED)).otherwise(F.lit("")))


def parse_equipment(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.struct(
        F.element_at(parts, 1).alias("slot"),
        F.try_element_at(parts, F.lit(2)).alias("item"),
        F.endswith(text, F.lit(_ENCHANTED)).alias("enchanted"),
    )


def boss_health_fixed(percent: Column) -> Column:
    """Hundredths, truncated, held within 0..10000."""
    return F.least(F.greatest((percent * 100).cast("int"), F.lit(0)), F.lit(10000))


def payload_preview(data: Column, shown: int = 32) -> Column:
    """Hex of the leading bytes, with an ellipsis when more follow."""
    return F.concat(F.lower(F.hex(F.substring(data, 1, shown))),
                    F.when(F.octet_length(data) > shown, F.lit("...")).otherwise(F.lit("")))
