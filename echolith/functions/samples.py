"""Sample conversions as Spark columns: integer, floating-point and companded encodings.

Every function takes and returns a column and stays inside whole-stage codegen. Casts that C would do
by truncation are guarded, since ANSI casts raise on overflow. NaN counts as larger than any number,
so clipping takes it to the positive limit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def _d(x: float) -> Column:
    return F.lit(float(x))


def wrap16(x: Column) -> Column:
    """The low 16 bits as a signed number, as a C cast does."""
    return (((x + 32768).bitwiseAND(65535)) - 32768).cast("short")


def wrap32(x: Column) -> Column:
    x = x.cast("long")
    return ((x + 2147483648).bitwiseAND(F.lit(4294967295)) - 2147483648).cast("int")


def signed(x: Column, bits: int) -> Column:
    """An unsigned number of so many bits read as two's complement."""
    return F.when(x >= (1 << (bits - 1)), x - (1 << bits)).otherwise(x)


# To 16 bits


def u8_to_s16(x: Column) -> Column:
    return (x * 256 - 32768).cast("short")


def s24_to_s16(x: Column) -> Column:
    return F.shiftright(x.cast("int"), 8).cast("short")


def s32_to_s16(x: Column) -> Column:
    return F.shiftright(x.cast("int"), 16).cast("short")


def f32_to_s16(x: Column) -> Column:
    """Clip to [-1, 1], scale by half of 65535 and truncate."""
    clipped = F.greatest(_f(-1), F.least(_f(1), x.cast("float")))
    return (((clipped + _f(1)) * _f(32767.5)).cast("int") - 32768).cast("short")


def f64_to_s16(x: Column) -> Column:
    clipped = F.greatest(_d(-1), F.least(_d(1), x.cast("double")))
    return (((clipped + _d(1)) * _d(32767.5)).cast("int") - 32768).cast("short")


def alaw_to_s16(code: Column) -> Column:
    """G.711 A-law by its bit formula."""
    y = code.cast("int").bitwiseXOR(85)
    step = F.shiftleft(y.bitwiseAND(15), 4) + 8
    segment = F.shiftright(y.bitwiseAND(112), 4)
    size = F.when(segment > 0, F.call_function("shiftleft", step + 256, segment - 1)).otherwise(step)
    return F.when(y.bitwiseAND(128) != 0, size).otherwise(-size).cast("short")


def mulaw_to_s16(code: Column) -> Column:
    """G.711 mu-law by its bit formula."""
    y = 255 - code.cast("int")
    size = F.call_function("shiftleft", F.shiftleft(y.bitwiseAND(15), 3) + 132, F.shiftright(y.bitwiseAND(112), 4)) - 132
    return F.when(y.bitwiseAND(128) != 0, -size).otherwise(size).cast("short")


# To 32-bit float


def u8_to_f32(x: Column) -> Column:
    """0..255 to -1..1 by 2/255: not the /256 of other libraries."""
    return x.cast("float") * _f(0.00784313725490196078) - _f(1)


def s16_to_f32(x: Column) -> Column:
    return x.cast("float") * _f(0.000030517578125)


def s24_to_f32(x: Column) -> Column:
    return (x.cast("int") / _d(8388608)).cast("float")


def s32_to_f32(x: Column) -> Column:
    return (x.cast("int") / _d(2147483648)).cast("float")


def f64_to_f32(x: Column) -> Column:
    return x.cast("float")


def alaw_to_f32(code: Column) -> Column:
    return s16_to_f32(alaw_to_s16(code))


def mulaw_to_f32(code: Column) -> Column:
    return s16_to_f32(mulaw_to_s16(code))


# To 32 bits


def u8_to_s32(x: Column) -> Column:
    return ((x.cast("int") - 128) * 16777216).cast("int")


def s16_to_s32(x: Column) -> Column:
    return (x.cast("int") * 65536).cast("int")


def s24_to_s32(x: Column) -> Column:
    return (x.cast("int") * 256).cast("int")


def f32_to_s32(x: Column) -> Column:
    """Scale by 2^31, truncate and saturate; in C the upper end overflows."""
    scaled = (x.cast("float") * _f(2147483648)).cast("double")
    return F.greatest(_d(-2147483648), F.least(_d(2147483647), scaled)).cast("int")


def f64_to_s32(x: Column) -> Column:
    return F.greatest(_d(-2147483648), F.least(_d(2147483647), x.cast("double") * _d(2147483648))).cast("int")


def alaw_to_s32(code: Column) -> Column:
    return s16_to_s32(alaw_to_s16(code))


def mulaw_to_s32(code: Column) -> Column:
    return s16_to_s32(mulaw_to_s16(code))


# Integers of 5 to 8 bytes


def wide_to_s16(x: Column, width: int) -> Column:
    return F.shiftright(x.cast("long"), 8 * width - 16).cast("short")


def wide_to_s32(x: Column, width: int) -> Column:
    return F.shiftright(x.cast("long"), 8 * width - 32).cast("int")


def wide_to_f32(x: Column, width: int) -> Column:
    left = F.shiftleft(x.cast("long"), 64 - 8 * width)
    return (left.cast("double") / _d(9223372036854775807.0)).cast("float")


# MPEG output


def mp3_f32_to_s16_round(x: Column) -> Column:
    """Scale by 32768, saturate, add a half and truncate; below zero one less."""
    v = x.cast("float") * _f(32768)
    near = F.when((v < _f(32766.5)) & (v > _f(-32767.5)), (v + _f(0.5)).cast("int"))
    return F.when(v >= _f(32766.5), 32767).when(v <= _f(-32767.5), -32768).otherwise(near - F.when(near < 0, 1).otherwise(0)).cast("short")


def mp3_f32_to_s16_trunc(x: Column) -> Column:
    clipped = F.greatest(_f(-1), F.least(_f(1), x.cast("float")))
    return (clipped * _f(32767)).cast("int").cast("short")


# Bytes


def aiff_s8_to_u8(x: Column) -> Column:
    """Signed 8-bit AIFF samples as the unsigned ones of WAV."""
    return F.pmod(x.cast("int") + 128, F.lit(256)).cast("int")


def swap16(x: Column) -> Column:
    u = x.cast("int").bitwiseAND(65535)
    return wrap16(F.shiftleft(u.bitwiseAND(255), 8) + F.shiftright(u, 8))


def swap24(x: Column) -> Column:
    u = x.cast("int").bitwiseAND(0xFFFFFF)
    return signed(F.shiftleft(u.bitwiseAND(255), 16) + u.bitwiseAND(0xFF00) + F.shiftright(u, 16), 24).cast("int")


def swap32(x: Column) -> Column:
    u = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [F.shiftleft(F.shiftright(u, 8 * k).bitwiseAND(F.lit(255)), 24 - 8 * k) for k in range(4)]
    return wrap32(parts[0] + parts[1] + parts[2] + parts[3])


def bytes_to_uint(data: Column, at: int, size: int, big: bool = False) -> Column:
    """An unsigned number of up to 7 bytes from a binary column, ``at`` counted from 0."""
    order = range(size) if big else range(size - 1, -1, -1)
    digits = F.concat(*(F.hex(F.substring(data, at + 1 + k, 1)) for k in order))
    return F.conv(digits, 16, 10).cast("long")


def bytes_to_int(data: Column, at: int, size: int, big: bool = False) -> Column:
    """A signed number of up to 8 bytes from a binary column."""
    if size == 8:
        order = range(8) if big else range(7, -1, -1)
        return F.conv(F.concat(*(F.hex(F.substring(data, at + 1 + k, 1)) for k in order)), 16, -10).cast("long")
    return signed(bytes_to_uint(data, at, size, big), 8 * size)


def bytes_to_u64(data: Column, at: int, big: bool = False) -> Column:
    """An unsigned number of 8 bytes, as a decimal."""
    order = range(8) if big else range(7, -1, -1)
    return F.conv(F.concat(*(F.hex(F.substring(data, at + 1 + k, 1)) for k in order)), 16, 10).cast("decimal(20,0)")


def bytes_to_f32(data: Column, at: int, big: bool = False) -> Column:
    """A 32-bit float from a binary column in either byte order, exactly."""
    u = bytes_to_uint(data, at, 4, big)
    sign = F.when(F.shiftright(u, 31) == 1, _d(-1)).otherwise(_d(1))
    exponent, fraction = F.shiftright(u, 23).bitwiseAND(F.lit(255)), u.bitwiseAND(F.lit(0x7FFFFF)).cast("double") / _d(1 << 23)
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small, normal = sign * fraction * _d(2.0**-126), sign * (_d(1) + fraction) * F.pow(_d(2), (exponent - 127).cast("double"))
    return F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal).cast("float")


def swap64(x: Column) -> Column:
    """The eight bytes of a long in the other order."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.conv(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8))), 16, -10).cast("long")


# Pseudo-random numbers of the multiplicative generator modulo 2^31 - 1


def lcg(state: Column) -> Column:
    """The number behind ``state`` in the sequence."""
    return F.pmod(state.cast("long") * 48271, F.lit(2147483647)).cast("int")


def lcg_unit(number: Column) -> Column:
    """A number of the sequence as a double from 0 to 1."""
    return number.cast("double") / _d(2147483647)


def bits(data: Column, first: int, count: int) -> Column:
    """``count`` bits, most significant first, from bit ``first`` of a number of 32 bits."""
    return F.shiftright(data.cast("long"), 32 - first - count).bitwiseAND(F.lit((1 << count) - 1))


CONVERSIONS = {
    ("u8", "s16"): u8_to_s16, ("s24", "s16"): s24_to_s16, ("s32", "s16"): s32_to_s16, ("f32", "s16"): f32_to_s16, ("f64", "s16"): f64_to_s16, ("alaw", "s16"): alaw_to_s16, ("mulaw", "s16"): mulaw_to_s16,
    ("u8", "f32"): u8_to_f32, ("s16", "f32"): s16_to_f32, ("s24", "f32"): s24_to_f32, ("s32", "f32"): s32_to_f32, ("f64", "f32"): f64_to_f32, ("alaw", "f32"): alaw_to_f32, ("mulaw", "f32"): mulaw_to_f32,
    ("u8", "s32"): u8_to_s32, ("s16", "s32"): s16_to_s32, ("s24", "s32"): s24_to_s32, ("f32", "s32"): f32_to_s32, ("f64", "s32"): f64_to_s32, ("alaw", "s32"): alaw_to_s32, ("mulaw", "s32"): mulaw_to_s32,
}


def convert(x: Column, source: str, target: str) -> Column:
    """Any pair of ``u8 s16 s24 s32 f32 f64 alaw mulaw`` and ``s16 s32 f32``."""
    return x if source == target else CONVERSIONS[source, target](x)
