"""Layers I and II against a decoder written one value at a time, on frames of random codes."""

import math
import random

import numpy as np
import pytest

from echolith import api
from echolith.sources import mpeg_audio
from echolith.sources.mpeg import Header, frames

RATES = {(1, 1): 9, (1, 2): 10, (2, 1): 10, (2, 2): 10}


class Writer:
    def __init__(self, head):
        self.bits = [int(x) for x in f"{head:032b}"]

    def put(self, value, width):
        self.bits += [int(x) for x in f"{value:0{width}b}"]


def levels_of(layer, mpeg1, each, rate, band):
    """Quantizer levels by the tables of the standard, spelt out."""
    if layer == 1:
        return 4, [0, 3, 7, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383, 32767]
    if not mpeg1:
        if band < 4:
            return 4, [0, 3, 5, 7, 9, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383]
        return (3, [0, 3, 5, 9, 15, 31, 63, 127]) if band < 11 else (2, [0, 3, 5, 9])
    if each < 56:
        return (4, [0, 3, 5, 9, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383, 32767]) if band < 2 else (3, [0, 3, 5, 9, 15, 31, 63, 127])
    if band < 3:
        return 4, [0, 3, 7, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383, 32767, 65535]
    if band < 11:
        return 4, [0, 3, 5, 7, 9, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 65535]
    return (3, [0, 3, 5, 7, 9, 15, 31, 65535]) if band < 23 else (2, [0, 3, 5, 65535])


def bands_of(layer, mpeg1, each, rate):
    if layer == 1:
        return 32
    if not mpeg1:
        return 30
    if each < 56:
        return 12 if rate == 32000 else 8
    return 30 if each >= 96 and rate != 48000 else 27


def frame(rng, layer, mpeg1, index, rate_index, mode, extension, crc=False, loud=1.0):
    """A frame of random codes, and its subband samples (steps, 32, channels)."""
    head = 0x7FF << 21 | (3 if mpeg1 else 2) << 19 | (4 - layer) << 17 | (0 if crc else 1) << 16 | index << 12 | rate_index << 10 | mode << 6 | extension << 4
    h = Header(head)
    size, channels, w = h.size(), h.channels, Writer(head)
    if crc:
        w.put(rng.randrange(65536), 16)
    bands = bands_of(layer, mpeg1, h.kbps // channels, h.rate)
    bound = min(bands, 4 * extension + 4) if mode == 1 else bands
    room = 8 * size - 32 - 16 * crc
    tables = [levels_of(layer, mpeg1, h.kbps // channels, h.rate, b) for b in range(bands)]
    chosen = [[0] * channels for _ in range(bands)]
    room -= sum(t[0] * (channels if b < bound else 1) for b, t in enumerate(tables))
    for b in rng.sample(range(bands), bands):
        for c in range(channels if b < bound else 1):
            k = rng.randrange(len(tables[b][1]))
            n = tables[b][1][k]
            if not n:
                continue
            width = {3: 5, 5: 7, 9: 10}.get(n, 3 * n.bit_length()) if layer == 2 else n.bit_length()
            cost = 12 * width + (20 if layer == 2 else 6) * (channels if b >= bound else 1)
            if cost <= room:
                room -= cost
                for own in range(c, channels if b >= bound else c + 1):
                    chosen[b][own] = k
    for b in range(bands):
        for c in range(channels if b < bound else 1):
            w.put(chosen[b][c], tables[b][0])
    used = [(b, c) for b in range(bands) for c in range(channels) if chosen[b][c]]
    kinds = {x: rng.randrange(4) for x in used}
    if layer == 2:
        for x in used:
            w.put(kinds[x], 2)
    scale = {}
    for x in used:
        one = [rng.randrange(int(6 * loud), 63) for _ in range(3)]
        if layer == 1:
            w.put(one[0], 6)
            scale[x] = [one[0]] * 3
            continue
        sent = {0: one, 1: [one[0], one[2]], 2: one[:1], 3: one[:2]}[kinds[x]]
        for v in sent:
            w.put(v, 6)
        scale[x] = {0: one, 1: [one[0], one[0], one[2]], 2: [one[0]] * 3, 3: [one[0], one[1], one[1]]}[kinds[x]]
    per = 3 if layer == 2 else 1
    out = np.zeros((12 * per, 32, channels))
    for granule in range(12):
        for b in range(bands):
            for c in range(channels if b < bound else 1):
                if not chosen[b][c]:
                    continue
                n = tables[b][1][chosen[b][c]]
                values = [rng.randrange(n) for _ in range(per)]
                if per == 3 and n in (3, 5, 9):
                    w.put(values[0] + n * values[1] + n * n * values[2], {3: 5, 5: 7, 9: 10}[n])
                else:
                    for v in values:
                        w.put(v, n.bit_length())
                for own in range(c, channels if b >= bound else c + 1):
                    for k, v in enumerate(values):
                        out[granule * per + k, b, own] = (2 * v + 1 - n) / n * 2 ** (1 - scale[b, own][granule // 4] / 3)
    bits = w.bits + [0] * (8 * size - len(w.bits))
    assert len(bits) == 8 * size
    return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8)), out


def slow_synthesis(samples):
    """The flow chart of the standard: shift, matrix, window, sum."""
    d = mpeg_audio.window()
    out = np.zeros((32 * samples.shape[0], samples.shape[2]))
    for c in range(samples.shape[2]):
        v = [0.0] * 1024
        for t in range(samples.shape[0]):
            v = [sum(math.cos((16 + i) * (2 * k + 1) * math.pi / 64) * samples[t, k, c] for k in range(32) if samples[t, k, c]) for i in range(64)] + v[:-64]
            u = [0.0] * 512
            for i in range(8):
                for j in range(32):
                    u[64 * i + j], u[64 * i + 32 + j] = v[128 * i + j], v[128 * i + 96 + j]
            for j in range(32):
                out[32 * t + j, c] = sum(u[j + 32 * i] * d[j + 32 * i] for i in range(16))
    return out


SHAPES = [(1, True, 9, 0, 3, 0), (1, True, 10, 1, 1, 1), (1, False, 8, 2, 0, 0), (2, True, 10, 0, 3, 0), (2, True, 14, 1, 0, 0), (2, True, 12, 0, 1, 2), (2, True, 5, 2, 1, 0), (2, True, 2, 0, 3, 0), (2, False, 10, 0, 1, 3), (2, False, 6, 1, 3, 0), (2, True, 11, 2, 1, 3)]


@pytest.mark.parametrize("shape", SHAPES)
def test_frames_of_random_codes(shape):
    rng = random.Random(str(shape))
    made = [frame(rng, *shape, crc=k % 2 == 0) for k in range(3)]
    for data, want in made:
        got = mpeg_audio.subbands(data, Header.at(data, 0))
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-12)
    whole = np.concatenate([x for _, x in made])
    assert np.allclose(mpeg_audio.synthesis(whole), slow_synthesis(whole), atol=1e-9)


def test_window_is_symmetric_and_reconstructs():
    assert len(mpeg_audio.WINDOW) == 257 and abs(mpeg_audio.window()[256] - 1.144989014) < 1e-9
    # A sine analysed with the standard's filter and put together again comes out as it was, 481 samples late.
    c, n = mpeg_audio.window() / 32, 32 * 60
    x = np.sin(np.arange(n) * 0.21) * 0.5
    padded = np.concatenate((np.zeros(512), x))
    matrix = np.cos((np.arange(64) - 16)[None] * (2 * np.arange(32) + 1)[:, None] * np.pi / 64)
    steps = []
    for t in range(60):
        z = padded[t * 32 + 32 : t * 32 + 544][::-1] * c
        steps.append(matrix @ z.reshape(8, 64).sum(axis=0))
    back = mpeg_audio.synthesis(np.array(steps)[:, :, None])[:, 0]
    assert np.abs(back[481:] - x[: n - 481]).max() < 1e-4


def test_streams_seek_and_lose_their_sync(spark):
    rng = random.Random(9)
    made = [frame(rng, 2, True, 10, 0, 1, 1) for _ in range(30)]
    data = b"".join(d for d, _ in made)
    want = mpeg_audio.synthesis(np.concatenate([x for _, x in made]))
    assert len(list(frames(data))) == 30
    for most in (1, 4, 256):
        parts = list(mpeg_audio.decoded(data, target="f32", most=most))
        assert [at for at, _ in parts] == np.cumsum([0] + [len(x) for _, x in parts[:-1]]).tolist()
        assert np.allclose(np.concatenate([x for _, x in parts]), want, atol=1e-5)
    for first, count in ((0, 10), (1151, 2), (5000, 3000), (30 * 1152 - 5, None), (10**6, 5)):
        got = [x for _, x in mpeg_audio.decoded(data, target="f32", first=first, count=count)]
        assert np.allclose(np.concatenate(got) if got else np.zeros((0, 2)), want[first : None if count is None else first + count], atol=1e-5)
    # Bytes of other data between two halves: the second begins in silence.
    broken = data[: len(data) // 2] + b"\0" * 5000 + data[len(data) // 2 :]
    got = np.concatenate([x for _, x in mpeg_audio.decoded(broken, target="f32")])
    second = mpeg_audio.synthesis(np.concatenate([x for _, x in made[15:]]))
    assert np.allclose(got[-len(second) :], second, atol=1e-5)
    layer3 = (b"\xff\xfb\x90\x00" + bytes(413)) * 12
    audio = spark.createDataFrame([("a", data), ("b", b"ID3\x04\0\0\0\0\0\x0a" + bytes(10) + data), ("c", layer3), ("d", b"none"), ("e", None)], "path string, content binary")
    rows = api.decode_mpeg(audio, "s16").orderBy("path", "frame_idx").collect()
    pcm = mpeg_audio.to_s16(want)
    assert [(r.path, r.frame_idx, r.samples) for r in rows] == [(p, k, x) for p in "ab" for k, x in enumerate(pcm.tolist())]
    assert api.decode_mpeg(audio, "f32", first=40, count=7).count() == 14
    for bad in "cd":
        with pytest.raises(Exception, match="Layer III|MPEG|shorter"):
            api.decode_mpeg(audio.where(f"path = '{bad}'"), strict=True).count()
    assert list(mpeg_audio.decoded(data[:200])) == []


def test_rounding():
    x = np.array([0, 0.5 / 32768, 1.5 / 32768, -0.5 / 32768, -0.4 / 32768, -1.2 / 32768, 1.0, -1.0, 2.0, -3.0, 32766.4 / 32768, 32766.6 / 32768], np.float32)
    assert mpeg_audio.to_s16(x).tolist() == [0, 1, 2, 0, 0, 0, 32767, -32768, 32767, -32768, 32766, 32767]
