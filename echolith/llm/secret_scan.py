"""Secret scans with a recursive decoding worklist.

The base patterns run over the whole text. Then a worklist unwraps what the text nests: percent
escapes, Unicode escapes (``\\uXXXX``, ``\\u{X}``, ``\\UXXXXXXXX``, ``\\xXX``), base64, and compressed streams in what that
gives. Each layer is scanned with the same patterns and searched for further layers until nothing new appears; a
layer that was seen before at its place ends its branch, which ends cycles. A span found in a layer
is carried back through the layers above it to code points of the text: a character of an escaped
layer maps to the escape that made it, a character of base64 to the whole encoded run (of lines of uneven width, to
the lines that hold it), one of a compressed stream to the run that holds the stream.

Nothing has to be text: bytes are scanned as they are, one character each, and once more without their zeros, which
shows what UTF-16 and UTF-32 say in ASCII. An escape that is no valid UTF-8 or a half of a surrogate pair stands for
a character of its own. A base64 run of 20 or more characters is decoded from each of its first four, so that what
stands before the code does not put it out of step. Runs that only line breaks part are joined before they are
decoded, lines of one width as a block, and each line is also decoded alone. Streams of gzip, zlib, bzip2 and xz are
found anywhere in the bytes, unfolded through all members and levels, and scanned as far as they go where they are damaged.

Not decoded: other codes (entities, base32, quoted-printable), other compression and archives, encryption, base64
parted by other characters than line breaks, white space and escaped line breaks. One bound stays, against bombs: where the
streams within one run unfold to more than ``MOST_INFLATED`` bytes in all, the run is scanned that far and reported as a
span of kind ``partial``: the document was not fully scanned. The run is redacted like a secret.

Nulls and empty texts have no span. Repeated rows are scanned each. Spans come sorted by start, then
kind in the order assign, access, hex, partial; equal spans appear once. A layer's way back is kept in
stretches, so a long text takes memory in proportion to its length and its escapes.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import packed, rows, table

KINDS = ("assign", "access", "hex", "partial")
PARTIAL = 3
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Runs that fail for their length lie within no other match of their kind, so the length stands in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}))+")
ESCAPE = re.compile(r"\\(?:[uUx]([0-9A-Fa-f]+)|u\{([0-9A-Fa-f]+)\})")
ZEROS = re.compile("\0+")
#: 20 characters hold 15 bytes, less than the shortest secret with its name.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: How streams of gzip, zlib, bzip2 and xz begin (fixed values of the formats).
STREAM = re.compile("\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\0")
#: Runs that only line breaks part, which may be escaped; no run is tried again from its inside.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"(?<![A-Za-z0-9+/_\\-])[A-Za-z0-9+/_-]+|(?<=\\[nr])[A-Za-z0-9+/_-]+")
#: Bytes that the compressed streams within one run may unfold to, all levels and members together.
MOST_INFLATED = 64 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a number, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A text with its escapes undone, in pieces: plain stretches, and characters that an escape made."""

    text: str
    starts: list[int]  # of each piece in ``text``
    sources: list[int]  # where it begins in the layer above
    ends: list[int]  # where an escape ends there; -1 for a plain stretch
    above: Where

    def left(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.sources[k] + (at - self.starts[k] if self.ends[k] < 0 else 0)

    def right(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.sources[k] + at - self.starts[k] + 1 if self.ends[k] < 0 else self.ends[k]


@dataclass
class Lines:
    """The bytes of a base64 run that was joined from lines; a byte maps to the lines that hold it."""

    sums: list[int]  # where each line begins in the joined run
    lines: list[tuple[int, int]]  # where it stands in the layer above
    phase: int
    above: Where

    def left(self, at: int) -> int:
        return self.lines[bisect_right(self.sums, self.phase + at // 3 * 4) - 1][0]

    def right(self, at: int) -> int:
        return self.lines[bisect_right(self.sums, min(self.phase + at // 3 * 4 + 3, self.sums[-1])) - 1][1]


#: What leads back from a layer: a step to the layer above, a span of the whole text that all of it came from, or nothing.
Where = Layer | Lines | tuple[int, int] | None


def origin(where: Where, start: int, end: int) -> tuple[int, int]:
    """A span of a layer as a span of the whole text."""
    while isinstance(where, (Layer, Lines)):
        start, end, where = where.left(start), where.right(end - 1), where.above
    return (start, end) if where is None else where


def undone(text: str, pattern: re.Pattern, decode, above) -> Layer | None:
    out = Layer("", [], [], [], above)
    parts, size, at = [], 0, 0

    def add(chars: str, source: int, end: int) -> None:
        nonlocal size
        if chars:
            parts.append(chars)
            out.starts.append(size)
            out.sources.append(source)
            out.ends.append(end)
            size += len(chars)

    for m in pattern.finditer(text):
        add(text[at : m.start()], at, -1)
        for chars, start, end in decode(m[0]):
            add(chars, m.start() + start, m.start() + end)
        at = m.end()
    if not at:
        return None
    add(text[at:], at, -1)
    out.text = "".join(parts)
    return out if parts else None


def percent(run: str) -> list[tuple[str, int, int]]:
    """The characters of percent escapes; a byte that is no valid UTF-8 stands for itself."""
    data, out, at = unquote_to_bytes(run), [], 0
    while at < len(data):
        n = 1 if data[at] < 0x80 else 2 if data[at] >> 5 == 6 else 3 if data[at] >> 4 == 14 else 4
        try:
            out.append((data[at : at + n].decode(), 3 * at, 3 * (at + n)))
        except UnicodeDecodeError:
            n = 1
            out.append((chr(data[at]), 3 * at, 3 * at + 3))
        at += n
    return out


def unicode_escapes(run: str) -> list[tuple[str, int, int]]:
    """The characters of Unicode escapes; half a pair and what is beyond Unicode stands for U+FFFD."""
    out: list[tuple[str, int, int]] = []
    high = 0
    for m in ESCAPE.finditer(run):
        code, start = int(m[1] or m[2], 16), m.start()
        if high and 0xDC00 <= code < 0xE000:
            code, start = 0x10000 + (high - 0xD800 << 10) + code - 0xDC00, out.pop()[1]
        high = code if 0xD800 <= code < 0xDC00 else 0
        out.append((chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "\ufffd", start, m.end()))
    return out


def no_zeros(run: str) -> list[tuple[str, int, int]]:
    return []


def unfolder(data: memoryview):
    """What unfolds a stream that begins like this; a dictionary of more than 128 MiB is refused."""
    if data[0] in b"\x1f\x78":
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if data[0] == 66 else lzma.LZMADecompressor(lzma.FORMAT_XZ, 1 << 27)


def inflated(data: memoryview, most: int) -> tuple[bytes, int, bool]:
    """What a compressed stream and the members right behind it unfold to, how long it is (0 if it is damaged), and whether that is all, below ``most`` bytes."""
    parts, size, at, step = [], 0, 0, 1 << 16
    while STREAM.match(str(data[at : at + 16], "latin-1")):
        unfold, held, part = unfolder(data[at:]), b"", b""
        flate = hasattr(unfold, "unconsumed_tail")
        try:
            while not unfold.eof:
                if not held and (flate or unfold.needs_input):
                    held = data[at : at + step]
                    at += len(held)
                    if not held and not part:
                        return b"".join(parts), 0, True
                part = unfold.decompress(held, step)
                held = unfold.unconsumed_tail if flate else b""
                if size + len(part) > most:
                    return b"".join(parts), 0, False
                parts.append(part)
                size += len(part)
        except (zlib.error, OSError, EOFError, ValueError):
            return b"".join(parts), 0, True
        except lzma.LZMAError as e:
            return b"".join(parts), 0, "limit" not in str(e)
        at -= len(unfold.unused_data)
        while at < len(data) and not data[at]:
            at += 1
    return b"".join(parts), at, True


def decoded(run: str) -> Iterator[tuple[int, str]]:
    """The bytes of a base64 run, as characters, from each of its first four characters on."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for phase in range(4):
        part = body[phase : len(body) - ((len(body) - phase) % 4 == 1)]
        if len(part) > 15:
            yield phase, binascii.a2b_base64(part + "=" * (-len(part) % 4)).decode("latin-1")


def wrapped(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, lines) of what may be base64 in lines of one width, the last shorter and the first after other text."""
    for m in WRAPPED.finditer(text):
        if m.end() - m.start() < 20:
            continue
        lines = [(x.start(), x.end()) for x in LINE.finditer(text, m.start(), m.end())]
        widths = [b - a for a, b in lines]
        at, even = 0, False
        while at < len(lines):
            stop = at + 1
            while stop < len(lines) and widths[stop] == widths[at]:
                stop += 1
            if widths[at] >= 20:
                tail = stop < len(lines) and widths[stop] < widths[at]
                even = even or (at <= 1 and stop + tail == len(lines))
                for first in {at, max(at - 1, 0)}:
                    for last in {stop, stop + tail, stop - 1}:
                        if last - first > 1:
                            yield lines[first][0], m.end() if last == len(lines) else lines[last - 1][1], lines[first:last]
            at = stop
        if not even and sum(widths) >= 20:
            yield -1, m.end(), lines


def nested_spans(text: str) -> set[tuple[int, int, int]]:
    """Spans in decoded layers, as code points of ``text``."""
    found: set[tuple[int, int, int]] = set()
    seen: set = set()
    #: A layer's text, its way back, the bytes that streams may yet unfold to within its outermost run, and whether
    #: its characters are bytes.
    work: list[tuple[str, Where, list[int] | None, bool]] = [(text, None, None, False)]

    def unfold(layer: str, where: Where, left: list[int]) -> None:
        at, data = 0, memoryview(layer.encode("latin-1"))
        while m := STREAM.search(layer, at):
            plain, size, whole = inflated(data[m.start() :], left[0])
            left[0] -= len(plain)
            if not whole:
                first, last = origin(where, m.start(), len(layer))
                found.add((first, PARTIAL, last))
            if plain:
                work.append((plain.decode("latin-1"), origin(where, m.start(), m.start() + size if size else len(layer)), left, True))
            # A damaged stream may be none: what is behind its head is searched too.
            at = m.start() + size if size else m.end()

    while work:
        layer, where, left, is_bytes = work.pop()
        key = layer if len(layer) < 64 else hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if (key := (key, where and origin(where, 0, len(layer)))) in seen:
            continue
        seen.add(key)
        if where is not None:
            for start, kind, end in base_spans(layer):
                first, last = origin(where, start, end)
                found.add((first, kind, last))
        if is_bytes:
            unfold(layer, where, left)
        for pattern, decode, mark in ((PERCENT, percent, "%"), (UNICODE, unicode_escapes, "\\"), (ZEROS, no_zeros, "\0")):
            if mark in layer and (got := undone(layer, pattern, decode, where)):
                work.append((got.text, where if isinstance(where, tuple) else got, left, False))
        if "%" in layer:
            for m in PERCENT.finditer(layer):
                if len(m[0]) >= 60 and STREAM.search(raw := unquote_to_bytes(m[0]).decode("latin-1")):
                    work.append((raw, origin(where, m.start(), m.end()), left or [MOST_INFLATED], True))
        for m in BASE64.finditer(layer):
            span, budget = origin(where, m.start(), m.end()), left or [MOST_INFLATED]
            work += [(plain, span, budget, True) for _, plain in decoded(m[0])]
        if "\n" in layer or "\r" in layer or "\\n" in layer:
            for start, end, lines in wrapped(layer):
                run, budget = "".join(layer[a:b] for a, b in lines), left or [MOST_INFLATED]
                if start >= 0 or isinstance(where, tuple):
                    span = origin(where, lines[0][0], end)
                    work += [(plain, span, budget, True) for _, plain in decoded(run)]
                else:
                    sums = [0, *accumulate(b - a for a, b in lines[:-1])]
                    work += [(plain, Lines(sums, [*lines[:-1], (lines[-1][0], end)], phase, where), budget, True) for phase, plain in decoded(run)]
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    more = nested_spans(text)
    return base, sorted({*base, *more}) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every run of overlapping spans replaced by ``mark``."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<kind,start,end,is_base>>`` for every row; one pass, no shuffle."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = base.schema["_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("is_base", pa.bool_())])

        def found() -> Iterator[tuple]:
            for i, text in rows(batches, "_id", "_text"):
                base, all_ = scan(text)
                own = set(base)
                yield i, [{"kind": KINDS[x[1]], "start": x[0], "end": x[2], "is_base": x in own} for x in all_]

        yield from packed(found(), pa.schema([("_id", to_arrow_type(id_type)), ("spans", pa.list_(span))]))

    out = base.mapInArrow(work, f"_id {id_type.simpleString()}, spans array<struct<kind:string,start:long,end:long,is_base:boolean>>")
    return out.withColumnRenamed("_id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the secrets of the text replaced."""
    kept = F.pandas_udf(lambda s: s.map(redacted, na_action="ignore"), "string")
    return docs.select(*(kept(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["is_base"])

    def text(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:PARTIAL]]
    return spans.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
