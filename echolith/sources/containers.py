"""WAV-family containers: RIFF, RIFX, RF64, Wave64, AIFF and AIFC, read from bytes.

One walk over the chunks yields the format, the place of the samples, the chunk table and the metadata.
Malformed input never raises: a ``status`` other than ``ok`` says what is wrong. Every length is bounded
by the bytes that are there.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from echolith.functions.headers import ALAW, IMA_ADPCM, MAX_BITS, MAX_CHANNELS, MAX_RATE, MS_ADPCM, MULAW

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Wave64 identifiers: a FourCC and twelve fixed bytes; the outer one differs (fixed values of the format).
W64_TAIL = bytes.fromhex("F3ACD3118CD100C04F8EDB8A")
W64_RIFF = b"riff" + bytes.fromhex("2E91CF11A5D628DB04C10000")
INFO = {
    "ISFT": "software", "ICOP": "copyright", "INAM": "title", "IART": "artist", "ICMT": "comment", "ICRD": "date", "IGNR": "genre",
    "IPRD": "album", "ITRK": "track", "IARL": "location", "ICMS": "organization", "IKEY": "keywords", "ISBJ": "subject", "IMED": "medium",
}
COMPRESSIONS = {b"NONE": PCM, b"raw ": PCM, b"sowt": PCM, b"fl32": FLOAT, b"fl64": FLOAT, b"FL32": FLOAT, b"FL64": FLOAT, b"alaw": ALAW, b"ALAW": ALAW, b"ulaw": MULAW, b"ULAW": MULAW}


@dataclass
class Audio:
    """What a container says; ``status`` is ``ok`` or a reason why the samples cannot be read."""

    status: str = "ok"
    container: str | None = None
    format_tag: int = 0
    channels: int = 0
    sample_rate: int = 0
    avg_bytes: int = 0
    block_align: int = 0
    bits_per_sample: int = 0
    valid_bits: int = 0
    channel_mask: int = 0
    sub_format: bytes | None = None
    data_pos: int = 0
    data_size: int = 0
    total_pcm_frames: int = 0
    big_endian: bool = False
    unsigned8: bool = True
    chunks: list[dict] = field(default_factory=list)
    metadata: list[dict] = field(default_factory=list)

    @property
    def tag(self) -> int:
        """The format tag, that of the sub-format where the format is extensible."""
        return struct.unpack("<H", self.sub_format[:2])[0] if self.format_tag == EXTENSIBLE and self.sub_format else self.format_tag

    @property
    def frame_size(self) -> int:
        size = self.bits_per_sample * self.channels // 8 if self.bits_per_sample % 8 == 0 else self.block_align
        return 0 if self.tag in (ALAW, MULAW) and size != self.channels else size


class Malformed(Exception):
    pass


def need(condition: bool, why: str) -> None:
    if not condition:
        raise Malformed(why)


def extended(data: bytes) -> int:
    """An 80-bit float, truncated towards zero."""
    exponent, mantissa = struct.unpack(">HQ", data)
    shift = (exponent & 0x7FFF) - 16383 - 63
    whole = mantissa >> -shift if shift <= 0 else min(mantissa << shift, (1 << 63) - 1)
    return -whole if exponent & 0x8000 else whole


def parse(content: bytes, sequential: bool = False, metadata: bool = True, size: int | None = None) -> Audio:
    """Reads a container. ``sequential`` stops at the samples and keeps no metadata.

    ``size`` is the file's size where ``content`` is its beginning only.
    """
    out, data = Audio(), bytes(content)
    try:
        _walk(out, data, len(data) if size is None else size, sequential, metadata and not sequential)
        _finish(out, len(data) if size is None else size)
    except Malformed as e:
        out.status = str(e)
    except struct.error:
        out.status = "truncated"
    return out


def _probe(out: Audio, data: bytes) -> int:
    """Sets the container and returns where the chunks begin."""
    four = data[:4]
    if four in (b"RIFF", b"RIFX", b"RF64"):
        need(len(data) >= 12 and data[8:12] == b"WAVE", "not a WAVE form")
        need(four != b"RF64" or data[4:8] == b"\xff\xff\xff\xff", "RF64 size must be 0xFFFFFFFF")
        out.container = {b"RIFF": "riff", b"RIFX": "rifx", b"RF64": "rf64"}[four]
        out.big_endian = four == b"RIFX"
        return 12
    if data[:16] == W64_RIFF:
        need(len(data) >= 40 and struct.unpack_from("<Q", data, 16)[0] >= 80, "W64 size below 80")
        need(data[24:40] == b"wave" + W64_TAIL, "not a wave form")
        out.container = "w64"
        return 40
    if four == b"FORM":
        need(len(data) >= 12 and struct.unpack_from(">I", data, 4)[0] >= 18, "FORM size below 18")
        need(data[8:12] in (b"AIFF", b"AIFC"), "not an AIFF form")
        out.container, out.big_endian, out.unsigned8 = "aiff", True, False
        return 12
    raise Malformed("unknown container")


def _walk(out: Audio, data: bytes, size: int, sequential: bool, metadata: bool) -> None:
    at = _probe(out, data)
    e = ">" if out.big_endian else "<"
    aifc = data[8:12] == b"AIFC"
    seen_format = seen_data = False
    long_data = frames = 0
    if out.container == "rf64":
        need(data[at : at + 4] == b"ds64", "RF64 without ds64")
        n, _, long_data, frames = struct.unpack_from("<IQQQ", data, at + 4)
        need(n >= 28, "ds64 below 28 bytes")
        out.chunks.append({"id": b"ds64", "offset": at + 8, "size": n, "padding": n % 2})
        at += 8 + n + n % 2
    while at + (24 if out.container == "w64" else 8) <= len(data):
        if out.container == "w64":
            id_, n = data[at : at + 16], struct.unpack_from("<Q", data, at + 16)[0] - 24
            if n < 0:
                need(seen_format and seen_data, "W64 chunk below 24 bytes")
                break
            name = id_[:4] if id_[4:] == W64_TAIL else id_
            body, pad = at + 24, n % 8
        else:
            id_, n = data[at : at + 4], struct.unpack_from(e + "I", data, at + 4)[0]
            name, body, pad = id_, at + 8, n % 2
        if name == b"data" and out.container == "rf64" and long_data:
            n = long_data
            pad = n % 2
        out.chunks.append({"id": id_, "offset": body, "size": n, "padding": pad})
        inside = data[body : body + n]
        if name == b"fmt " and out.container != "aiff":
            _format(out, inside, n, e)
            seen_format = True
        elif name == b"data" and out.container != "aiff":
            need(seen_format or not sequential, "data before fmt")
            if not seen_data:
                out.data_pos, out.data_size = body, n
            seen_data = True
            if sequential:
                break
        elif name == b"fact" and out.container == "w64":
            frames = struct.unpack_from("<Q", inside)[0]
        elif name == b"COMM" and out.container == "aiff":
            frames = _common(out, inside, n, aifc)
            seen_format = True
        elif name == b"SSND" and out.container == "aiff":
            need(seen_format or not sequential, "SSND before COMM")
            skip, _ = struct.unpack_from(">II", inside)
            out.data_pos, out.data_size, seen_data = body + 8 + skip, max(0, n - skip), True
            if sequential:
                break
        elif metadata and out.container in ("riff", "rf64") and name != b"fact":
            _metadata(out.metadata, name, inside, n, seen_data)
        at = body + n + pad
    need(seen_format, "no format chunk")
    need(seen_data, "no data chunk")
    out.total_pcm_frames = frames


def _format(out: Audio, body: bytes, n: int, e: str) -> None:
    need(n >= 16, "fmt below 16 bytes")
    out.format_tag, out.channels, out.sample_rate, out.avg_bytes, out.block_align, out.bits_per_sample = struct.unpack_from(e + "HHIIHH", body)
    if n > 16 and out.format_tag == EXTENSIBLE:
        extra = struct.unpack_from(e + "H", body, 16)[0]
        need(extra == 22, "extensible format needs 22 bytes")
        out.valid_bits, out.channel_mask = struct.unpack_from(e + "HI", body, 18)
        out.sub_format = body[24:40]
        need(len(out.sub_format) == 16, "truncated")


def _common(out: Audio, body: bytes, n: int, aifc: bool) -> int:
    need(n >= 24 if aifc else n == 18, "COMM of a wrong size")
    out.channels, frames, out.bits_per_sample = struct.unpack_from(">HIH", body)
    out.sample_rate = extended(body[8:18])
    need(0 <= out.sample_rate <= 0xFFFFFFFF, "sample rate out of range")
    kind = body[18:22] if aifc else b"NONE"
    need(kind in COMPRESSIONS, "unsupported AIFC compression")
    out.format_tag = COMPRESSIONS[kind]
    out.big_endian = kind != b"sowt"
    out.unsigned8 = kind == b"raw "
    out.block_align = out.channels * out.bits_per_sample // 8 & 0xFFFF
    if out.format_tag in (ALAW, MULAW) and out.bits_per_sample > 8:
        out.bits_per_sample, out.block_align = 8, out.channels
    # Right for 4, 12 and 20 bits; 10 bits become 12, as the formats' readers have it.
    out.bits_per_sample += out.bits_per_sample & 7
    out.avg_bytes = out.block_align * out.sample_rate & 0xFFFFFFFF
    return frames


def _finish(out: Audio, size: int) -> None:
    need(0 < out.sample_rate <= MAX_RATE, "sample rate out of range")
    need(0 < out.channels <= MAX_CHANNELS, "channels out of range")
    need(0 < out.bits_per_sample <= MAX_BITS, "bits out of range")
    need(out.block_align != 0, "block align is zero")
    compressed = out.tag in (MS_ADPCM, IMA_ADPCM)
    need(not compressed or out.channels <= 2, "ADPCM with more than two channels")
    there = max(0, size - out.data_pos)
    out.data_size = there if out.data_size == 0xFFFFFFFF and out.container in ("riff", "rifx") else min(out.data_size, there)
    if not compressed:
        need(out.frame_size > 0, "no bytes in a frame")
        out.data_size -= out.data_size % out.frame_size
    if out.total_pcm_frames:
        return
    if compressed:
        blocks = -(-out.data_size // out.block_align)
        header = (6 if out.tag == MS_ADPCM else 4) * out.channels * blocks
        need(header < out.data_size, "no samples in the ADPCM blocks")
        out.total_pcm_frames = (out.data_size - header) * 2 // out.channels + (blocks if out.tag == IMA_ADPCM else 0)
    else:
        out.total_pcm_frames = out.data_size // out.frame_size


# Metadata


def _text(data: bytes) -> str:
    data = data.split(b"\0", 1)[0]
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _fields(names: str, layout: str, body: bytes, at: int = 0) -> dict:
    return dict(zip(names.split(), struct.unpack_from("<" + layout, body, at), strict=True))


SMPL = "manufacturer product sample_period midi_note midi_fraction smpte_format smpte_offset"
LOOP = "cue_point_id type first last fraction play_count"
POINT = "id position chunk_id chunk_start block_start sample_offset"
INST = "midi_note fine_tune gain low_note high_note low_velocity high_velocity"
ACID = "flags root_note reserved1 reserved2 beats meter_denominator meter_numerator tempo"
LOUDNESS = "loudness_value loudness_range max_true_peak max_momentary max_short_term"


def _metadata(out: list[dict], name: bytes, body: bytes, n: int, after_data: bool) -> None:
    add = lambda type_, **values: out.append({"type": type_, "raw": body, **values})
    whole = len(body) == n
    if name in (b"LIST", b"list"):
        _list(out, body)
    elif name == b"smpl" and whole and n >= 36:
        head = _fields(SMPL, "7I", body)
        loops, own = struct.unpack_from("<II", body, 28)
        if loops * 24 + own <= n - 36:
            add("smpl", smpl=head | {"loops": [_fields(LOOP, "6I", body, 36 + 24 * k) for k in range(loops)], "data": body[36 + 24 * loops : 36 + 24 * loops + own]})
    elif name == b"inst" and whole and n == 7:
        add("inst", inst=_fields(INST, "BbbBBBB", body))
    elif name == b"cue " and whole and n >= 4:
        points = struct.unpack_from("<I", body)[0]
        fits = points == (n - 4) // 24
        add("cue", cue={"count": points, "points": [_fields(POINT, "II4sIII", body, 4 + 24 * k) for k in range(points)] if fits else []})
    elif name == b"acid" and whole and n == 24:
        add("acid", acid=_fields(ACID, "IHHfIHHf", body))
    elif name == b"bext" and whole and n >= 602:
        low, high, version = struct.unpack_from("<IIH", body, 338)
        bext = {"description": _text(body[:256]), "originator": _text(body[256:288]), "originator_reference": _text(body[288:320]), "origination_date": _text(body[320:330]), "origination_time": _text(body[330:338])}
        add("bext", bext=bext | {"time_reference": high << 32 | low, "version": version, "umid": body[348:412], "coding_history": _text(body[602:])} | _fields(LOUDNESS, "5h", body, 412))
    else:
        add("unknown", id=name, location="after_data" if after_data else "before_data")


def _list(out: list[dict], body: bytes) -> None:
    kind, at = body[:4], 4
    while at + 8 <= len(body):
        name, n = body[at : at + 4], struct.unpack_from("<I", body, at + 4)[0]
        inside = body[at + 8 : at + 8 + n]
        if len(inside) < n:
            break
        row = {"raw": inside, "id": name}
        if kind == b"adtl" and name in (b"labl", b"note") and n >= 4:
            out.append(row | {"type": "label" if name == b"labl" else "note", "cue_point_id": struct.unpack_from("<I", inside)[0], "text": _text(inside[4:])})
        elif kind == b"adtl" and name == b"ltxt" and n >= 20:
            values = _fields("cue_point_id sample_length purpose country language dialect code_page", "II4sHHHH", inside)
            out.append(row | {"type": "region", "cue_point_id": values["cue_point_id"], "text": _text(inside[20:]), "region": values})
        elif kind == b"INFO" and name.decode("latin-1") in INFO:
            out.append(row | {"type": INFO[name.decode("latin-1")], "text": _text(inside)})
        else:
            out.append(row | {"type": "unknown", "location": {b"INFO": "info_list", b"adtl": "adtl_list"}.get(kind, "other_list")})
        at += 8 + n + n % 2
