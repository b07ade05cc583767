"""Column builders that decode fixed layouts inside Catalyst: integers, flags, modes, identifiers, durations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions import layout


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def le(data: Column | str, offset: int | Column, width: int) -> Column:
    """Little-endian unsigned integer at ``offset``; 8 bytes give a decimal(20,0), for Spark has no unsigned long."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.concat(*[F.hex(F.substring(_col(data), at + (k + 1), F.lit(1))) for k in range(width - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")


def be(data: Column | str, offset: int, width: int) -> Column:
    """Big-endian unsigned integer."""
    return F.conv(F.hex(F.substring(_col(data), offset + 1, width)), 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")


def signed(value: Column, width: int) -> Column:
    """An unsigned integer of ``width`` bytes as two's complement."""
    half, full = 1 << (8 * width - 1), 1 << (8 * width)
    return F.when(value >= half, value - full).otherwise(value)


def raw(data: Column | str, offset: int, width: int) -> Column:
    return F.substring(_col(data), offset + 1, width)


def c_string(data: Column) -> Column:
    """Bytes up to the first zero byte as text; null if they aren't UTF-8."""
    hexed = F.hex(data)
    end = F.regexp_extract(hexed, "^((?:(?!00)..)*)", 1)
    return F.try_validate_utf8(F.unhex(end).cast("string"))


def has(value: Column | str, mask: int) -> Column:
    return _col(value).bitwiseAND(F.lit(mask)) != 0


def flags(value: Column | str, names: Mapping[int, str]) -> Column:
    """Struct of booleans, one per named mask."""
    return F.struct(*[has(value, m).alias(n) for m, n in names.items()])


def flag_names(value: Column | str, names: Mapping[int, str]) -> Column:
    """Names of the set masks, space-joined, ``none`` if no one is."""
    set_names = F.filter(F.array(*[F.when(has(value, m), F.lit(n)) for m, n in names.items()]), lambda n: n.isNotNull())
    return F.coalesce(F.nullif(F.array_join(set_names, " "), F.lit("")), F.lit("none"))


def masked(value: Column | str, masks: list[int]) -> Column:
    """``value & mask`` for each mask."""
    return F.array(*[_col(value).bitwiseAND(F.lit(m)) for m in masks])


def uuid_text(data: Column) -> Column:
    """16 bytes, or 32 hexadecimal digits, as 8-4-4-4-12."""
    return dashed(F.lower(F.hex(data)))


def dashed(digits: Column) -> Column:
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def human_duration(seconds: Column | str) -> Column:
    """Hours, minutes and seconds: 26h03m09s."""
    s = _col(seconds).cast("bigint")
    return F.format_string("%dh%02dm%02ds", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def seconds_since(start: Column | str) -> Column:
    """Seconds from an epoch time to now."""
    return F.unix_timestamp() - _col(start)


def hex_text(value: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(_col(value))))


def _choose(value: Column, names: Mapping[int, str], default: Column) -> Column:
    out = None
    for k, n in names.items():
        out = F.when(value == k, n) if out is None else out.when(value == k, n)
    return out.otherwise(default)


def mode_type(mode: Column | str) -> Column:
    """File type by the mode's type bits, by equality."""
    return _choose(_col(mode).bitwiseAND(F.lit(0xF000)), layout.MODE_TYPES, F.lit("unknown"))


def dirent_type(code: Column | str) -> Column:
    return _choose(_col(code), layout.DIRENT_TYPES, F.lit(None).cast("string"))


def permissions(mode: Column | str) -> Column:
    """Struct of what other, group and user may do, and of the special bits."""
    who = [F.struct(*[has(mode, m).alias(a) for a, m in rights.items()]).alias(w) for w, rights in layout.PERMISSIONS.items()]
    return F.struct(*who, *[has(mode, m).alias(n) for n, m in layout.SPECIAL_BITS.items()])


def bit(data: Column | str, number: Column) -> Column:
    """Bit ``number`` (least significant first) of a bitmap held as bytes."""
    byte = F.conv(F.hex(F.substring(_col(data), F.floor(number / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (number % 8).cast("int")) == 1


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("bigint")
