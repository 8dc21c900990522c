"""Arithmetic on container and frame headers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALAW, MULAW, MS_ADPCM, IMA_ADPCM = 6, 7, 2, 17
#: Limits of a format that is taken for valid.
MAX_RATE, MAX_CHANNELS, MAX_BITS = 384000, 256, 64


def bytes_per_frame(tag: Column, bits: Column, channels: Column, block_align: Column) -> Column:
    """Bytes of one PCM frame; 0 if a companded format does not use one byte a channel."""
    size = F.when(bits % 8 == 0, (bits * channels / 8).cast("int")).otherwise(block_align)
    return F.when(tag.isin(ALAW, MULAW) & (size != channels), 0).otherwise(size).cast("int")


def valid_format(rate: Column, channels: Column, bits: Column, block_align: Column) -> Column:
    return (rate > 0) & (rate <= MAX_RATE) & (channels > 0) & (channels <= MAX_CHANNELS) & (bits > 0) & (bits <= MAX_BITS) & (block_align != 0)


def frames_pcm(data_size: Column, frame_size: Column) -> Column:
    return F.floor(data_size / frame_size).cast("long")


def _blocks(data_size: Column, block_align: Column) -> Column:
    return F.ceil(data_size / block_align)


def frames_ms_adpcm(data_size: Column, block_align: Column, channels: Column) -> Column:
    """Two samples a byte beyond six header bytes a channel and block, which hold the other two."""
    return F.floor((data_size - _blocks(data_size, block_align) * 6 * channels) * 2 / channels).cast("long")


def frames_ima_adpcm(data_size: Column, block_align: Column, channels: Column) -> Column:
    blocks = _blocks(data_size, block_align)
    return (F.floor((data_size - blocks * 4 * channels) * 2 / channels) + blocks).cast("long")


def repaired_data_size(data_size: Column, data_pos: Column, file_size: Column, frame_size: Column, container: Column | str = "riff") -> Column:
    """Clamped to the file, and rounded down to whole frames; 0xFFFFFFFF reaches to the end in RIFF and RIFX, and is a size elsewhere."""
    container = F.lit(container) if isinstance(container, str) else container
    there = F.greatest(file_size - data_pos, F.lit(0))
    size = F.when((data_size == 0xFFFFFFFF) & container.isin("riff", "rifx"), there).otherwise(F.least(data_size, there))
    return (size - size % frame_size).cast("long")


def padding_riff(size: Column) -> Column:
    return (size % 2).cast("long")


def padding_w64(size: Column) -> Column:
    """``size % 8``, not what is missing to a multiple of eight; readers and writers here agree on it."""
    return (size % 8).cast("long")


def target_size(container: str, frames: Column, channels: Column, bits: Column, metadata: Column | int = 0) -> Column:
    """Bytes of a whole file before it is written."""
    data = F.floor(frames.cast("long") * channels * bits / 8).cast("long")
    metadata = F.lit(metadata) if isinstance(metadata, int) else metadata
    if container == "w64":
        return (data + padding_w64(data) + 104).cast("long")
    fixed = {"riff": 36, "rf64": 72}[container]
    return (F.least(metadata + data + padding_riff(data) + fixed, F.lit(0xFFFFFFFF)) + 8).cast("long")


def extended_to_long(data: Column, at: int = 0) -> Column:
    """The 80-bit float of AIFF rates, truncated; null beyond what a rate may be."""

    def byte(k: int) -> Column:
        return F.conv(F.hex(F.substring(data, at + 1 + k, 1)), 16, 10).cast("long")

    exponent = (byte(0).bitwiseAND(F.lit(127))) * 256 + byte(1) - 16383
    high = byte(2) * 16777216 + byte(3) * 65536 + byte(4) * 256 + byte(5)
    whole = F.when(exponent < 0, 0).when(exponent <= 31, F.call_function("shiftright", high, (31 - exponent).cast("int")))
    return F.when(byte(0) >= 128, F.when(whole == 0, 0)).otherwise(whole).cast("long")


# MPEG audio frame headers, as an unsigned 32-bit number

#: Kilobits a second by index 1 to 14 (fixed values of the standard).
BITRATES = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]


def _field(h: Column, shift: int, mask: int) -> Column:
    return F.shiftright(h.cast("long"), shift).bitwiseAND(F.lit(mask)).cast("int")


def mpeg_header(h: Column) -> dict[str, Column]:
    """Fields of a frame header: version (1, 2 or 25), layer, bitrate, rate, samples, bytes, padding, channels, valid."""
    version_bits, layer_bits, bitrate_index, rate_index = _field(h, 19, 3), _field(h, 17, 3), _field(h, 12, 15), _field(h, 10, 3)
    layer = 4 - layer_bits
    version = F.when(version_bits == 3, 1).when(version_bits == 2, 2).when(version_bits == 0, 25)
    valid = (_field(h, 21, 2047) == 2047) & ((version_bits >= 2) | ((version_bits == 0) & (layer_bits == 1))) & (layer_bits != 0) & (bitrate_index != 15) & (rate_index != 3)
    kbps = F.lit(0)
    for (major, own), rates in BITRATES.items():
        at = (F.when(version == 1, 1).otherwise(2) == major) & (layer == own) & bitrate_index.between(1, 14)
        kbps = F.when(at, F.get(F.array(*map(F.lit, rates)), bitrate_index - 1)).otherwise(kbps)
    hz = F.get(F.array(*map(F.lit, RATES)), rate_index)
    rate = F.when(version == 1, hz).when(version == 2, F.shiftright(hz, 1)).otherwise(F.shiftright(hz, 2))
    samples = F.when(layer == 1, 384).when((layer == 3) & (version != 1), 576).otherwise(1152)
    size = F.floor(samples * kbps * 125 / rate).cast("int")
    size = F.when(layer == 1, size - size % 4).otherwise(size)
    padding = F.when(_field(h, 9, 1) == 1, F.when(layer == 1, 4).otherwise(1)).otherwise(0)
    return {"valid": valid, "version": version, "layer": layer, "bitrate_kbps": kbps, "sample_rate": rate, "pcm_frames": samples, "frame_bytes": size, "padding": padding, "channels": F.when(_field(h, 6, 3) == 3, 1).otherwise(2)}


def same_stream(a: Column, b: Column) -> Column:
    """Whether two headers agree in version, layer, rate and in being free-format or not."""
    fixed = F.lit(0xFFFE0C00)
    free = _field(a, 12, 15) == 0
    return (a.cast("long").bitwiseAND(fixed) == b.cast("long").bitwiseAND(fixed)) & (free == (_field(b, 12, 15) == 0)) & (_field(b, 12, 15) != 15)
