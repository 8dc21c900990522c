"""Sample codecs on numpy arrays: what a decoding task runs for each file, byte range or block."""

from __future__ import annotations

import numpy as np

from echolith.functions.headers import ALAW, IMA_ADPCM, MS_ADPCM, MULAW
from echolith.sources.containers import FLOAT, PCM, Audio

#: IMA step sizes and index steps (fixed values of the codec).
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: MS-ADPCM adaptation and coefficients (fixed values of the codec).
MS_ADAPT = np.array([230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230], np.int64)
MS_COEF = np.array([[256, 0], [512, -256], [0, 0], [192, 64], [240, 0], [460, -208], [392, -232]], np.int64)


def _alaw() -> np.ndarray:
    y = np.arange(256) ^ 85
    step, segment = ((y & 15) << 4) + 8, (y & 112) >> 4
    size = np.where(segment > 0, (step + 256) << np.maximum(segment - 1, 0), step)
    return np.where(y & 128, size, -size).astype(np.int16)


def _mulaw() -> np.ndarray:
    y = 255 - np.arange(256)
    size = ((((y & 15) << 3) + 132) << ((y & 112) >> 4)) - 132
    return np.where(y & 128, -size, size).astype(np.int16)


COMPANDED = {ALAW: _alaw(), MULAW: _mulaw()}


def integers(raw: np.ndarray, width: int, big: bool) -> np.ndarray:
    """Signed integers of 2 to 8 bytes from an array of bytes."""
    raw = raw.reshape(-1, width)
    raw = raw[:, ::-1] if big else raw
    out = np.zeros(len(raw), np.int64)
    for k in range(width):
        out |= raw[:, k].astype(np.int64) << (64 - 8 * width + 8 * k)
    return out >> (64 - 8 * width)


def little(data: bytes, width: int) -> bytes:
    """Big-endian numbers of ``width`` bytes as little-endian ones."""
    return np.frombuffer(data[: len(data) - len(data) % width], np.uint8).reshape(-1, width)[:, ::-1].tobytes()


def native(audio: Audio, data: bytes) -> tuple[str, np.ndarray]:
    """The kind of a file's samples (u8, s16, s24, s32, f32, f64, wide or s16 from a companded code) and their values."""
    width, raw = audio.bits_per_sample // 8, np.frombuffer(data, np.uint8)
    order = ">" if audio.big_endian else "<"
    if audio.tag in COMPANDED:
        return "s16", COMPANDED[audio.tag][raw]
    if audio.tag == FLOAT:
        if width in (4, 8):
            return f"f{8 * width}", raw.view(f"{order}f{width}").astype(f"f{width}")
        return "s16", np.zeros(len(raw) // max(1, width), np.int16)
    if width == 1:
        return "u8", raw if audio.unsigned8 else raw + np.uint8(128)
    if width > 8 or width == 0:
        return "s16", np.zeros(len(raw) // max(1, width), np.int16)
    values = integers(raw, width, audio.big_endian)
    return ("s16", values.astype(np.int16)) if width == 2 else ("s24" if width == 3 else "s32" if width == 4 else "wide", values)


def to_s16(kind: str, x: np.ndarray, width: int = 0) -> np.ndarray:
    if kind == "s16":
        return x
    if kind == "u8":
        return (x.astype(np.int32) * 256 - 32768).astype(np.int16)
    if kind in ("f32", "f64"):
        one = x.dtype.type
        clipped = np.where(np.isnan(x), one(1), np.clip(x, one(-1), one(1)))
        return (((clipped + one(1)) * one(32767.5)).astype(np.int32) - 32768).astype(np.int16)
    return (x >> {"s24": 8, "s32": 16}.get(kind, 8 * width - 16)).astype(np.int16)


def to_f32(kind: str, x: np.ndarray, width: int = 0) -> np.ndarray:
    if kind == "f32":
        return x
    if kind == "f64":
        return x.astype(np.float32)
    if kind == "u8":
        return x.astype(np.float32) * np.float32(0.00784313725490196078) - np.float32(1)
    if kind == "s16":
        return x.astype(np.float32) * np.float32(0.000030517578125)
    if kind == "wide":
        return ((x << (64 - 8 * width)).astype(np.float64) / 9223372036854775807.0).astype(np.float32)
    return (x / {"s24": 8388608.0, "s32": 2147483648.0}[kind]).astype(np.float32)


def to_s32(kind: str, x: np.ndarray, width: int = 0) -> np.ndarray:
    if kind == "u8":
        return (x.astype(np.int32) - 128) * np.int32(16777216)
    if kind in ("f32", "f64"):
        scaled = (x * x.dtype.type(2147483648)).astype(np.float64)
        return np.where(np.isnan(scaled), 2147483647.0, np.clip(scaled, -2147483648.0, 2147483647.0)).astype(np.int64).astype(np.int32)
    if kind == "wide":
        return (x >> (8 * width - 32)).astype(np.int32)
    return (x.astype(np.int64) << {"s16": 16, "s24": 8, "s32": 0}[kind]).astype(np.int32)


#: ADPCM blocks that are decoded at once.
BLOCKS = 4096
TARGETS = {"s16": to_s16, "f32": to_f32, "s32": to_s32}


def decode(audio: Audio, content: bytes, target: str = "s16", first: int = 0, count: int | None = None) -> np.ndarray:
    """Frames [first, first + count) as an array (frames, channels); a short result is the end.

    Uncompressed frames are read from their own bytes; ADPCM starts at the block that holds ``first``.
    """
    last = audio.total_pcm_frames if count is None else min(audio.total_pcm_frames, first + count)
    if audio.status != "ok" or first >= last:
        return np.zeros((0, max(1, audio.channels)), {"s16": np.int16, "f32": np.float32, "s32": np.int32}[target])
    if audio.tag in (MS_ADPCM, IMA_ADPCM):
        size, parts = frames_per_block(audio), []
        start, stop = first // size, -(-last // size)
        for b in range(start, stop, BLOCKS):
            places = (audio.data_pos + k * audio.block_align for k in range(b, min(b + BLOCKS, stop)))
            got = decode_blocks(audio, [content[at : min(at + audio.block_align, audio.data_pos + audio.data_size)] for at in places])
            # What follows a block that cannot be read is not given.
            short = next((k + 1 for k, x in enumerate(got) if len(x) < size), None)
            parts += got[:short]
            if short:
                break
        pcm = np.concatenate(parts)[first - start * size : last - start * size]
        return TARGETS[target]("s16", pcm)
    size = audio.frame_size
    at = audio.data_pos + first * size
    data = content[at : min(audio.data_pos + last * size, audio.data_pos + audio.data_size)]
    data = data[: len(data) - len(data) % size]
    kind, values = native(audio, data)
    return TARGETS[target](kind, values, audio.bits_per_sample // 8).reshape(-1, audio.channels)


def frames_per_block(audio: Audio) -> int:
    """PCM frames of a whole ADPCM block; every block restates its state, so blocks decode alone."""
    if audio.tag == MS_ADPCM:
        return (audio.block_align - 7 * audio.channels) * 2 // audio.channels + 2
    return (audio.block_align - 4 * audio.channels) * 2 // audio.channels + 1


def decode_blocks(audio: Audio, blocks: list[bytes]) -> list[np.ndarray]:
    """The frames of each block as (frames, channels); blocks of one length are decoded side by side."""
    decoder, out = ms_blocks if audio.tag == MS_ADPCM else ima_blocks, [np.zeros((0, audio.channels), np.int16)] * len(blocks)
    sizes: dict[int, list[int]] = {}
    for k, block in enumerate(blocks):
        sizes.setdefault(len(block), []).append(k)
    for n, members in sizes.items():
        good, pcm = decoder(np.frombuffer(b"".join(blocks[k] for k in members), np.uint8).reshape(len(members), n), audio.channels)
        for k, found in zip(np.array(members)[good].tolist(), pcm, strict=True):
            out[k] = found
    return out


def words_of(blocks: np.ndarray, first: int, count: int, step: int = 2) -> np.ndarray:
    """Signed 16-bit numbers from the head of each block, ``step`` bytes apart."""
    at = first + step * np.arange(count)
    return (blocks[:, at].astype(np.int64) | blocks[:, at + 1].astype(np.int8).astype(np.int64) << 8)


def ms_blocks(blocks: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """Which MS-ADPCM blocks can be read, and the frames of those; a bad predictor index gives none."""
    head = 7 * channels
    if blocks.shape[1] < head:
        return np.zeros(len(blocks), bool), np.zeros((0, 0, channels), np.int16)
    good = (blocks[:, :channels] < len(MS_COEF)).all(axis=1)
    blocks = blocks[good]
    coef, rest = MS_COEF[blocks[:, :channels]], words_of(blocks, channels, 3 * channels)
    delta, late, early = rest[:, :channels], rest[:, channels : 2 * channels], rest[:, 2 * channels :]
    body = blocks[:, head:].astype(np.int64)
    steps = 2 * body.shape[1] // channels
    codes = np.stack([body >> 4, body & 15], axis=2).reshape(len(blocks), 2 * body.shape[1])
    codes = codes[:, : steps * channels].reshape(len(blocks), steps, channels)
    out = np.empty((len(blocks), codes.shape[1] + 2, channels), np.int16)
    out[:, 0], out[:, 1] = early, late
    for t in range(codes.shape[1]):
        code = codes[:, t]
        guess = (late * coef[..., 0] + early * coef[..., 1] >> 8) + (code - (code & 8) * 2) * delta
        late, early = np.clip(guess, -32768, 32767), late
        delta = np.maximum(16, MS_ADAPT[code] * delta >> 8)
        out[:, t + 2] = late
    return good, out


def ima_blocks(blocks: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """Which IMA blocks can be read, and the frames of those; a bad step index gives none."""
    head, group = 4 * channels, 4 * channels
    if blocks.shape[1] < head:
        return np.zeros(len(blocks), bool), np.zeros((0, 0, channels), np.int16)
    index = blocks[:, 2:head:4].astype(np.int64)
    good = (index <= 88).all(axis=1)
    blocks, index = blocks[good], index[good]
    value, body = words_of(blocks, 0, channels, 4), blocks[:, head:].astype(np.int64)
    # Each channel has four bytes in turn; the channel with the fewest ends the block.
    whole, left = divmod(body.shape[1], group)
    n = 4 * whole + max(0, min(4, left - 4 * (channels - 1)))
    groups = whole + (left > 0)
    padded = np.pad(body, ((0, 0), (0, groups * group - body.shape[1]))).reshape(len(blocks), groups, channels, 4)
    tracks = padded.transpose(0, 1, 3, 2).reshape(len(blocks), 4 * groups, channels)[:, :n]
    codes = np.stack([tracks & 15, tracks >> 4], axis=2).reshape(len(blocks), 2 * n, channels)
    out = np.empty((len(blocks), 2 * n + 1, channels), np.int16)
    out[:, 0] = value
    for t in range(2 * n):
        code, step = codes[:, t], IMA_STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        out[:, t + 1] = value
    return good, out
