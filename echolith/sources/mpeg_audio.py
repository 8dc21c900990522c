"""MPEG audio Layers I and II decoded to samples, a stretch of a stream at once.

The samples of a frame's 32 subbands are read by their widths in one gather; the synthesis filter is a matrix product
and sixteen shifted sums over all steps of a stretch, so the history that a decoder carries from frame to frame is the rows
before. A stretch ends where a stream loses its sync or changes; the history begins anew there. Layer III
frames are not decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from echolith.sources.mpeg import HEADER, Header, frames

#: Steps of history that the synthesis filter looks back on.
HISTORY = 15

#: The first half and the middle of the synthesis window D of the standard, times 65536, in order (fixed values).
WINDOW = [
    0, -1, -1, -1, -1, -1, -1, -2, -2, -2, -2, -3, -3, -4, -4, -5, -5, -6, -7, -7, -8, -9, -10, -11, -13, -14, -16, -17, -19, -21, -24, -26,
    -29, -31, -35, -38, -41, -45, -49, -53, -58, -63, -68, -73, -79, -85, -91, -97, -104, -111, -117, -125, -132, -139, -147, -154, -161, -169, -176, -183, -190, -196, -202, -208,
    213, 218, 222, 225, 227, 228, 228, 227, 224, 221, 215, 208, 200, 189, 177, 163, 146, 127, 106, 83, 57, 29, -2, -36, -72, -111, -153, -197, -244, -294, -347, -401,
    -459, -519, -581, -645, -711, -779, -848, -919, -991, -1064, -1137, -1210, -1283, -1356, -1428, -1498, -1567, -1634, -1698, -1759, -1817, -1870, -1919, -1962, -2001, -2032, -2057, -2075, -2085, -2087, -2080, -2063,
    2037, 2000, 1952, 1893, 1822, 1739, 1644, 1535, 1414, 1280, 1131, 970, 794, 605, 402, 185, -45, -288, -545, -814, -1095, -1388, -1692, -2006, -2330, -2663, -3004, -3351, -3705, -4063, -4425, -4788,
    -5153, -5517, -5879, -6237, -6589, -6935, -7271, -7597, -7910, -8209, -8491, -8755, -8998, -9219, -9416, -9585, -9727, -9838, -9916, -9959, -9966, -9935, -9863, -9750, -9592, -9389, -9139, -8840, -8492, -8092, -7640, -7134,
    6574, 5959, 5288, 4561, 3776, 2935, 2037, 1082, 70, -998, -2122, -3300, -4533, -5818, -7154, -8540, -9975, -11455, -12980, -14548, -16155, -17799, -19478, -21189, -22929, -24694, -26482, -28289, -30112, -31947, -33791, -35640,
    -37489, -39336, -41176, -43006, -44821, -46617, -48390, -50137, -51853, -53534, -55178, -56778, -58333, -59838, -61289, -62684, -64019, -65290, -66494, -67629, -68692, -69679, -70590, -71420, -72169, -72835, -73415, -73908, -74313, -74630, -74856, -74992,
    75038,
]


def window() -> np.ndarray:
    """All 512 values of D: its second half mirrors the first, with the sign turned but at multiples of 64."""
    half = np.array(WINDOW, float)
    mirrored = half[255:0:-1] * np.where(np.arange(257, 512) % 64 == 0, 1, -1)
    return np.concatenate((half, mirrored)) / 65536


D = window().reshape(16, 32)
#: Matrix from subband samples to the 64 values of a step.
MATRIX = np.cos((16 + np.arange(64))[:, None] * (2 * np.arange(32) + 1) * np.pi / 64)

#: Numbers of quantizer levels by allocation index, in Layer II (fixed values of the standard); 0 sends nothing.
FINE = [0, *(2**k - 1 for k in range(2, 17))]
MIDDLE = [0, 3, 5, 7, 9, *(2**k - 1 for k in range(4, 14)), 65535]
COARSE = [0, 3, 5, 7, 9, 15, 31, 65535]
FEW = [0, 3, 5, 65535]
LOW = [0, 3, 5, 9, *(2**k - 1 for k in range(4, 16))]
LOW_RATES = [0, 3, 5, 7, 9, *(2**k - 1 for k in range(4, 15))]
#: Three samples of so few levels make one code of so many bits.
GROUPED = {3: 5, 5: 7, 9: 10}


def allocations(h: Header) -> list[list[int]]:
    """The choice of quantizer levels that each subband has."""
    if h.layer == 1:
        return [[0, *(2**k - 1 for k in range(2, 16)), 0]] * 32
    if not h.mpeg1:
        return [LOW_RATES] * 4 + [LOW[:8]] * 7 + [LOW[:4]] * 19
    each = h.kbps // h.channels if not h.free else 192
    if each < 56:
        return [LOW] * 2 + [LOW[:8]] * (10 if h.rate == 32000 else 6)
    return [FINE] * 3 + [MIDDLE] * 8 + [COARSE] * 12 + [FEW] * (7 if each >= 96 and h.rate != 48000 else 4)


def bound_of(h: Header, bands: int) -> int:
    """The first subband whose codes both channels share."""
    joint = h.channels == 2 and h.bits(6, 3) == 1
    return min(bands, 4 * h.bits(4, 3) + 4) if joint else bands


def codes(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits from places in an array of bits; what lies behind its end is 0."""
    places = at[..., None] + np.arange(width)
    got = np.where(places < len(bits), bits[np.minimum(places, len(bits) - 1)], 0).astype(np.int64)
    return got @ (1 << np.arange(width - 1, -1, -1))


def subbands(frame: bytes, h: Header) -> np.ndarray | None:
    """The samples of a Layer I or II frame as (steps, subbands, channels), or None where it is too short for them."""
    choices, channels = allocations(h), h.channels
    bands, bits = len(choices), np.unpackbits(np.frombuffer(frame, np.uint8))
    bound, at = bound_of(h, bands), 8 * HEADER + (0 if h.bits(16, 1) else 16)

    whole = int.from_bytes(frame, "big")

    def read(width: int) -> int:
        nonlocal at
        at += width
        return (whole >> len(bits) - at if at <= len(bits) else whole << at - len(bits)) & (1 << width) - 1

    levels = np.zeros((bands, channels), np.int64)
    for band, choice in enumerate(choices):
        width = len(choice).bit_length() - 1
        for c in range(channels if band < bound else 1):
            levels[band, c] = choice[read(width)]
        if band >= bound:
            levels[band] = levels[band, 0]
    used = [(band, c) for band in range(bands) for c in range(channels) if levels[band, c]]
    scales = np.zeros((3, bands, channels))
    kinds = [read(2) for _ in used] if h.layer == 2 else [2] * len(used)
    for (band, c), kind in zip(used, kinds, strict=True):
        # Three factors for thirds of the frame; some are sent once for two or three of them.
        sent = [read(6) for _ in range({0: 3, 1: 2, 2: 1, 3: 2}[kind])]
        thirds = {0: [0, 1, 2], 1: [0, 0, 1], 2: [0, 0, 0], 3: [0, 1, 1]}[kind]
        scales[:, band, c] = [2.0 ** (1 - sent[k] / 3) for k in thirds]
    # Twelve granules of one layout: of each field its place, width, levels, subband and channels.
    per, fields, size = (3 if h.layer == 2 else 1), [], 0
    for band in range(bands):
        for c in range(channels if band < bound else 1):
            if n := int(levels[band, c]):
                width = GROUPED[n] if per == 3 and n in GROUPED else n.bit_length() * per
                fields.append((size, width, n, band, slice(c, c + 1) if band < bound else slice(0, channels)))
                size += width
    if at + 12 * size > len(bits):
        return None
    out, granules = np.zeros((12, per, 32, channels)), at + size * np.arange(12)
    for place, width, n, band, own in fields:
        if per == 3 and n in GROUPED:
            packed = codes(bits, granules + place, width)
            got = np.stack([packed // n**k % n for k in range(3)], axis=1)
        else:
            one = width // per
            got = codes(bits, granules[:, None] + place + one * np.arange(per), one)
        out[:, :, band, own] = ((got - (n - 1) / 2) * 2 / n)[:, :, None]
    third = np.arange(12) // 4
    out[:, :, :bands] *= scales[third][:, None]
    return out.reshape(12 * per, 32, channels)


def synthesis(samples: np.ndarray) -> np.ndarray:
    """PCM (32 a step, channels) from subband samples (steps, subbands, channels), from silence on."""
    steps = len(samples)
    v = np.concatenate((np.zeros((HISTORY, 64, samples.shape[2])), np.einsum("ik,tkc->tic", MATRIX, samples)))
    out = np.zeros((steps, 32, samples.shape[2]))
    for k in range(HISTORY + 1):
        part = slice(32, 64) if k % 2 else slice(0, 32)
        out += v[HISTORY - k : HISTORY - k + steps, part] * D[k][:, None]
    return out.reshape(32 * steps, -1)


def to_s16(x: np.ndarray) -> np.ndarray:
    """Scaled by 32768, rounded as the decoder's output is: a half up, below zero one less."""
    v = x.astype(np.float32) * np.float32(32768)
    near = np.clip(v + np.float32(0.5), -32768, 32767).astype(np.int32)
    near -= near < 0
    return np.where(v >= 32766.5, 32767, np.where(v <= -32767.5, -32768, near)).astype(np.int16)


TARGETS = {"s16": to_s16, "f32": lambda x: x.astype(np.float32)}


def decoded(data: bytes, start: int = 0, end: int | None = None, target: str = "s16", first: int = 0, count: int | None = None, most: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(first PCM frame, PCM frames by channels) of the frames [first, first + count) of a stream, some ``most`` MPEG frames at a time.

    Decoding begins two MPEG frames before ``first``, which fills the filter's history: the samples are those of decoding
    it all. A Layer III frame and a damaged one take their time and give none.
    """
    last = None if count is None else first + count
    history, held = None, []  # steps before the open stretch, and its samples by frame
    at = begun = 0  # PCM frames so far, and where the stretch begins
    expected, before = -1, None

    def close() -> Iterator[tuple[int, np.ndarray]]:
        nonlocal history, held
        if held:
            steps = np.concatenate(held if history is None else [history, *held])
            pcm = synthesis(steps)[32 * (0 if history is None else len(history)) :]
            low, high = max(first - begun, 0), len(pcm) if last is None else min(len(pcm), last - begun)
            if low < high:
                yield begun + low, TARGETS[target](pcm[low:high])
            history, held = steps[-HISTORY:], []

    for pos, n, h, pcm in frames(data, start, end):
        if last is not None and at >= last:
            break
        wanted = h.layer != 3 and at + 3 * h.samples > first
        samples = subbands(data[pos : pos + n], h) if wanted else None
        goes_on = pos == expected and h.like(before) and h.channels == before.channels
        if samples is None or not goes_on or len(held) >= most:
            yield from close()
            history = history if goes_on and samples is not None else None
        if samples is not None:
            begun = begun if held else at
            held.append(samples)
        at += pcm
        expected, before = pos + n, h
    yield from close()
