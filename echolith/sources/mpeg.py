"""MPEG audio streams: tags, frame headers and the frame table, read from bytes.

Compressed audio itself is not decoded: the frame table carries what seeking, counting and trimming need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from echolith.functions.headers import BITRATES, RATES

HEADER = 4
#: Frames that must follow alike before a header is believed, and the longest free-format frame.
SYNC_FRAMES, FREE_BYTES = 10, 2304
RESERVOIR = 511


@dataclass(frozen=True)
class Header:
    """One frame header."""

    value: int

    @staticmethod
    def at(data: bytes, pos: int) -> Header | None:
        if pos < 0 or pos + HEADER > len(data) or data[pos] != 0xFF:
            return None
        h = Header(int.from_bytes(data[pos : pos + HEADER], "big"))
        return h if h.valid else None

    def bits(self, shift: int, mask: int) -> int:
        return self.value >> shift & mask

    @property
    def valid(self) -> bool:
        version, layer = self.bits(19, 3), self.bits(17, 3)
        return self.bits(21, 2047) == 2047 and (version >= 2 or (version == 0 and layer == 1)) and layer != 0 and self.bits(12, 15) != 15 and self.bits(10, 3) != 3

    @property
    def mpeg1(self) -> bool:
        return self.bits(19, 3) == 3

    @property
    def layer(self) -> int:
        return 4 - self.bits(17, 3)

    @property
    def free(self) -> bool:
        return self.bits(12, 15) == 0

    @property
    def kbps(self) -> int:
        return 0 if self.free else BITRATES[1 if self.mpeg1 else 2, self.layer][self.bits(12, 15) - 1]

    @property
    def rate(self) -> int:
        return RATES[self.bits(10, 3)] >> {3: 0, 2: 1, 0: 2}[self.bits(19, 3)]

    @property
    def channels(self) -> int:
        return 1 if self.bits(6, 3) == 3 else 2

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and not self.mpeg1 else 1152

    @property
    def padding(self) -> int:
        return (4 if self.layer == 1 else 1) if self.bits(9, 1) else 0

    def size(self, free_bytes: int = 0) -> int:
        n = self.samples * self.kbps * 125 // self.rate
        return (n & ~3 if self.layer == 1 else n) or free_bytes

    @property
    def side_info(self) -> int:
        """Bytes of checksum and side information behind the header."""
        crc = 0 if self.bits(16, 1) else 2
        return crc + ((17 if self.channels == 1 else 32) if self.mpeg1 else (9 if self.channels == 1 else 17))

    def like(self, other: Header | None) -> bool:
        return other is not None and not (self.value ^ other.value) & 0xFFFE0C00 and self.free == other.free


def _followed(data: bytes, pos: int, free_bytes: int) -> bool:
    first, at = Header.at(data, pos), pos
    for n in range(SYNC_FRAMES):
        h = Header.at(data, at)
        at += h.size(free_bytes) + h.padding
        if at + HEADER > len(data):
            return n > 0
        if not first.like(Header.at(data, at)):
            return False
    return True


def _free_size(data: bytes, pos: int, h: Header) -> int:
    """The size of a free-format frame, from where the next two begin."""
    for k in range(HEADER, FREE_BYTES):
        if pos + 2 * k >= len(data) - HEADER:
            break
        if h.like(after := Header.at(data, pos + k)):
            n = k - h.padding
            third = pos + k + n + after.padding
            if third + HEADER <= len(data) and h.like(Header.at(data, third)):
                return n
    return 0


def frames(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, Header, int]]:
    """(position, bytes, header, PCM frames) of each frame from ``start``; garbage between is skipped.

    A Layer III frame whose bit reservoir is missing has no PCM frames but is there.
    """
    data = data[: len(data) if end is None else end]
    at, last, free_bytes, kept = start, None, 0, 0
    while at + HEADER < len(data):
        h = Header.at(data, at)
        n = h.size(free_bytes) + h.padding if h and last and last.like(h) else 0
        if n and at + n != len(data) and not (at + n + HEADER <= len(data) and h.like(Header.at(data, at + n))):
            n = 0
        if not n:
            kept = 0
            first, found = at, None
            while at < len(data) - HEADER:
                if h := Header.at(data, at):
                    free_bytes = _free_size(data, at, h) if h.free else 0
                    n = h.size(free_bytes) + h.padding
                    if (h.size(free_bytes) and at + n <= len(data) and _followed(data, at, free_bytes)) or (at == first and n == len(data) - at):
                        found = n
                        break
                at += 1
            if not found:
                return
            n = found
        last = h
        pcm = h.samples
        if h.layer == 3:
            body = data[at + HEADER + (0 if h.bits(16, 1) else 2) : at + n]
            begin = (int.from_bytes(body[:2], "big") >> 7 if h.mpeg1 else body[0]) if len(body) > 1 else 0
            have = min(kept, begin)
            pcm = pcm if kept >= begin else 0
            kept = min(RESERVOIR, have + max(0, n - HEADER - h.side_info))
        yield at, n, h, pcm
        at += n


@dataclass
class Stream:
    """Tags and totals of a stream; ``start`` and ``end`` bound the audio."""

    status: str = "ok"
    start: int = 0
    end: int = 0
    channels: int = 0
    sample_rate: int = 0
    tagged_frames: int | None = None
    total_pcm_frames: int | None = None
    delay: int = 0
    padding: int = 0
    is_vbr: bool = False
    is_cbr: bool = False
    tags: list[dict] = field(default_factory=list)


def open_stream(data: bytes) -> Stream:
    """Reads the trailing ID3v1 and APE tags, the leading ID3v2 tag, and a Xing or Info frame with LAME's delays."""
    s = Stream(end=len(data))
    if len(data) > 128 and data[-128:-125] == b"TAG":
        s.end -= 128
        s.tags.append({"type": "id3v1", "raw": data[s.end :]})
    if s.end > 32 and data[s.end - 32 : s.end - 24] == b"APETAGEX":
        size = 32 + int.from_bytes(data[s.end - 32 + 24 : s.end - 32 + 28], "little")
        if size < s.end:
            s.tags.append({"type": "ape", "raw": data[s.end - size : s.end]})
            s.end -= size
    if len(data) < 10:
        s.status = "shorter than 10 bytes"
        return s
    if data[:3] == b"ID3":
        size = 10 + sum((data[6 + k] & 127) << 7 * (3 - k) for k in range(4)) + (10 if data[5] & 16 else 0)
        if size <= len(data):
            s.tags.append({"type": "id3v2", "raw": data[:size]})
        s.start = size
    first = next(((p, n, h, pcm) for p, n, h, pcm in frames(data, s.start, s.end) if pcm), None)
    if first is None:
        s.status = "no MPEG frame"
        return s
    pos, n, h, pcm = first
    s.channels, s.sample_rate = h.channels, h.rate
    if h.layer == 3:
        _vbr_tag(s, data[pos : pos + n], h, pos, pcm)
    return s


def _vbr_tag(s: Stream, frame: bytes, h: Header, pos: int, pcm: int) -> None:
    at = begin = HEADER + h.side_info
    name = frame[at : at + 4]
    if len(frame) - at < 8 or name not in (b"Xing", b"Info"):
        return
    flags, at, total = frame[at + 7], at + 8, None
    for bit, size in ((1, 4), (2, 4), (4, 100), (8, 4)):
        if flags & bit:
            if len(frame) - at < size:
                return
            if bit == 1:
                total = int.from_bytes(frame[at : at + 4], "big")
            at += size
    if at < len(frame) and frame[at]:
        if len(frame) - at < 36:
            return
        packed = int.from_bytes(frame[at + 21 : at + 24], "big")
        s.delay, s.padding = (packed >> 12) + 529, max(0, (packed & 4095) - 529)
    s.is_vbr, s.is_cbr = name == b"Xing", name == b"Info"
    # Info tags are reported as vbri; real VBRI headers are not parsed.
    s.tags.append({"type": "xing" if s.is_vbr else "vbri", "raw": frame[begin:]})
    s.tagged_frames, s.start = total, pos + len(frame)
    if total is not None:
        s.total_pcm_frames = total * pcm
