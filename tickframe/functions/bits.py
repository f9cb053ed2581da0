"""Flag words, key masks and their text form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickframe.schemas import FLAG_LETTERS, FLAG_NAMES, KEY_NAMES, MOUSE_NAMES


def bit(word: Column, index: int) -> Column:
    return F.getbit(word.cast("int"), F.lit(index)) == 1


def _unpack(word: Column, names: tuple[str, ...]) -> Column:
    return F.struct(*[bit(word, i).alias(name) for i, name in enumerate(names)])


def unpack_flags(word: Column) -> Column:
    """The 13 tick flags as a struct of booleans."""
    return _unpack(word, FLAG_NAMES)


def unpack_mouse(word: Column) -> Column:
    return _unpack(word, MOUSE_NAMES)


def unpack_keys(mask: Column) -> Column:
    return _unpack(mask, KEY_NAMES)


def pack_keys(pressed: dict[str, Column]) -> Column:
    """Seven pressed-key booleans folded into ``key_mask``; null counts as released."""
    bits = [F.shiftleft(F.coalesce(pressed[name], F.lit(False)).cast("int"), i)
            for i, name in enumerate(KEY_NAMES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def flag_string(word: Column) -> Column:
    """One letter per set flag, a dot per unset one."""
    return F.concat(*[F.when(bit(word, i), F.lit(letter)).otherwise(F.lit("."))
                      for i, letter in enumerate(FLAG_LETTERS)])


def rain_code(raining: Column) -> Column:
    return raining.cast("tinyint")
