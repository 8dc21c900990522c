"""Kernels against plain numpy models, over whole domains where they are small."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.functions import samples as S
from echolith.sources import codecs


def run(spark, values, kind, convert):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", convert(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


U8, S16 = np.arange(256), np.arange(-32768, 32768, 7)
rng = np.random.default_rng(5)
S24, S32 = rng.integers(-(1 << 23), 1 << 23, 2000), rng.integers(-(1 << 31), 1 << 31, 2000)
F32 = np.concatenate([rng.normal(0, 1, 2000), [-1, 0, 1, 2, -2, 0.999999, -0.999999]]).astype(np.float32)


@pytest.mark.parametrize(("source", "target"), [k for k in S.CONVERSIONS if k[0] in ("u8", "s16", "s24", "s32", "f32")])
def test_columns_agree_with_the_decoder(spark, source, target):
    values = {"u8": U8.astype(np.uint8), "s16": S16.astype(np.int16), "s24": S24, "s32": S32, "f32": F32}[source]
    kind = "float" if source == "f32" else "int"
    got = run(spark, [float(v) if source == "f32" else int(v) for v in values], kind, S.CONVERSIONS[source, target])
    want = codecs.TARGETS[target](source, values)
    assert got == want.tolist()


def test_companding_tables_are_the_published_corners(spark):
    assert codecs.COMPANDED[6][[0x00, 0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-5504, -8, 8, -32256, 32256]
    assert codecs.COMPANDED[7][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert run(spark, U8.tolist(), "int", S.alaw_to_s16) == codecs.COMPANDED[6].tolist()
    assert run(spark, U8.tolist(), "int", S.mulaw_to_s16) == codecs.COMPANDED[7].tolist()


def test_three_float_rules_stay_apart(spark):
    x = [2.5 / 32768, -0.75 / 32768, 1.0, -1.0, 0.5]
    assert run(spark, x, "float", S.mp3_f32_to_s16_round) == [3, 0, 32767, -32768, 16384]
    assert run(spark, x, "float", S.mp3_f32_to_s16_trunc) == [2, 0, 32767, -32767, 16383]
    assert run(spark, x, "float", S.f32_to_s16)[2:] == [32767, -32768, 16383]


def test_floats_without_a_number_and_beyond_the_ends(spark):
    x = [math.nan, math.inf, -math.inf]
    assert run(spark, x, "float", S.f32_to_s16) == [32767, 32767, -32768]
    assert run(spark, x, "float", S.f32_to_s32) == [2147483647, 2147483647, -2147483648]
    assert run(spark, [None], "float", S.f32_to_s16) in ([None], [32767])


def test_swaps_undo_themselves(spark):
    for swap, values in ((S.swap16, S16[:500]), (S.swap24, S24[:500]), (S.swap32, S32[:500])):
        assert run(spark, values.tolist(), "int", lambda x, s=swap: s(s(x))) == values.tolist()
    assert run(spark, [0x1234], "int", S.swap16) == [0x3412]


def test_wrap_is_a_cast(spark):
    assert run(spark, [40000, -40000, 5], "int", S.wrap16) == [-25536, 25536, 5]


def test_wide_integers_are_left_aligned(spark):
    assert run(spark, [1 << 38, -(1 << 39)], "long", lambda x: S.wide_to_s16(x, 5)) == [16384, -32768]
    assert run(spark, [1 << 38], "long", lambda x: S.wide_to_f32(x, 5)) == [0.5]
