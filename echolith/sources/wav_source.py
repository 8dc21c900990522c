"""``spark.read.format("wav")`` and ``df.write.format("wav")``.

Reading: files are cut into byte ranges of ``bytesPerPartition``, and small ones are put together, by their sizes alone;
tasks read the headers. A frame belongs to the range that holds its first byte (of its block, in ADPCM). Where there are no more
than ``PLANNED`` files, or ``framesPerPartition`` is given, planning reads the headers too, cuts by frames, and drops the ranges
that filters on ``frame_idx`` rule out; tasks heed those filters in either case, and filters on ``path`` drop files before
anything is read (both need ``spark.sql.python.filterPushdown.enabled``, which ``echolith.api.register`` sets). Paths are those that Python
can open on every worker; contents in other stores go through ``binaryFile`` and ``echolith.sources.tables``.

Writing: rows ``stream, frame_idx, samples`` become one file a stream, which must lie in one partition
(``repartition("stream")``), sorted within it or at least in sorted pieces that follow one another. Samples go to the file as they
come; its sizes are set at the end, or, where the option ``frames`` promises a count, written at once and checked at the end. Tasks write
under hidden names; the commit checks the files' sizes and renames all of them, and in mode ``overwrite`` removes the other ones.
Characters of a stream's name that a file's name cannot hold are percent-escaped.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from echolith.functions.headers import IMA_ADPCM, MS_ADPCM
from echolith.operators.encode import checked_format, pack, wav_frame
from echolith.sources.codecs import decode, frames_per_block
from echolith.sources.containers import Audio, parse
from echolith.sources.rows import pcm_batches
from echolith.sources.tables import VALUE

HEAD = 1 << 16
#: Files whose headers are read to plan.
PLANNED = 64
#: What opening a file counts for beside its bytes.
OPEN_BYTES = 1 << 20
#: Stands for a stream without a name, whose file is ``%null.wav``: no escaped name is that.
NULL = "\0null"


@dataclass
class Part(InputPartition):
    """Pieces of files: path, whether the bounds are frames (or else bytes), first and last bound."""

    pieces: list[tuple[str, bool, int, int]]


def head_of(path: str) -> Audio:
    """The header, from the beginning of the file, or all of it where the samples begin late."""
    size, n = os.path.getsize(path), HEAD
    while True:
        with open(path, "rb") as f:
            audio = parse(f.read(n), metadata=False, size=size)
        if audio.status == "ok" or n >= size:
            return audio
        n = min(size, n * 16)


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        found = (p for part in options["path"].split(",") for p in (glob.glob(f"{glob.escape(part)}/[!_.]*") if os.path.isdir(part) else glob.glob(part)))
        self.paths = sorted(p for p in found if os.path.isfile(p))
        self.target, self.step = options.get("target", "s16"), int(options.get("framesperpartition", 0))
        self.bytes = int(options.get("bytesperpartition", 32 << 20))
        self.low, self.high, self.wanted = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("frame_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif name == ("path",) and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Part]:
        paths = [p for p in self.paths if self.wanted is None or p in self.wanted]
        parts: list[Part] = []
        held, weight = [], 0
        for path in paths:
            if self.step or len(paths) <= PLANNED:
                audio = head_of(path)
                step = self.step or max(1, self.bytes // max(1, audio.block_align) * _frames_before(audio, audio.block_align) if audio.status == "ok" else 1)
                end = audio.total_pcm_frames if audio.status == "ok" else 0
                end = end if self.high is None else min(end, self.high)
                pieces = [(path, True, k, min(end, k + step)) for k in range(max(0, self.low), end, step)]
                sizes = [(hi - lo) * max(1, audio.block_align) for _, _, lo, hi in pieces] if not self.step else [self.bytes] * len(pieces)
            else:
                size = os.path.getsize(path)
                pieces = [(path, False, k, min(size, k + self.bytes)) for k in range(0, size, self.bytes)]
                sizes = [hi - lo for _, _, lo, hi in pieces]
            for piece, size in zip(pieces, sizes, strict=True):
                if held and weight + size > self.bytes:
                    parts.append(Part(held))
                    held, weight = [], 0
                held.append(piece)
                weight += size + OPEN_BYTES
        return [*parts, Part(held)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        kind = {"s16": pa.int16(), "s32": pa.int32(), "f32": pa.float32()}[self.target]
        schema = pa.schema([("path", pa.string()), ("frame_idx", pa.int64()), ("samples", pa.list_(kind))])
        yield from pcm_batches((x for piece in part.pieces for x in self.frames(*piece)), schema)

    def frames(self, path: str, are_frames: bool, first: int, last: int) -> Iterator[tuple[str, int, np.ndarray]]:
        audio = head_of(path)
        if audio.status != "ok":
            return
        if not are_frames:
            first, last = _frame_from(audio, first), _frame_from(audio, last) if last < os.path.getsize(path) else audio.total_pcm_frames
        first, last = max(first, self.low), min(last, audio.total_pcm_frames, audio.total_pcm_frames if self.high is None else self.high)
        with open(path, "rb") as f:
            for at in range(first, last, 1 << 14):
                n = min(1 << 14, last - at)
                start, stop = _bytes(audio, at, n)
                f.seek(audio.data_pos + start)
                before = _frames_before(audio, start)
                own = Audio(**{**vars(audio), "data_pos": 0, "data_size": stop - start, "total_pcm_frames": audio.total_pcm_frames - before})
                yield path, at, decode(own, f.read(stop - start), self.target, at - before, n)


def _bytes(audio: Audio, first: int, count: int) -> tuple[int, int]:
    """The bytes of the samples that hold these frames."""
    if audio.tag in (MS_ADPCM, IMA_ADPCM):
        size = frames_per_block(audio)
        return first // size * audio.block_align, min(audio.data_size, -(-(first + count) // size) * audio.block_align)
    return first * audio.frame_size, min(audio.data_size, (first + count) * audio.frame_size)


def _frames_before(audio: Audio, at: int) -> int:
    return at // audio.block_align * frames_per_block(audio) if audio.tag in (MS_ADPCM, IMA_ADPCM) else at // max(1, audio.frame_size)


def _frame_from(audio: Audio, at: int) -> int:
    """The first frame whose bytes, or block, begin at a byte of the file or behind it."""
    at = max(0, at - audio.data_pos)
    size = audio.block_align if audio.tag in (MS_ADPCM, IMA_ADPCM) else audio.frame_size
    return _frames_before(audio, -(-at // size) * size)


def file_name(stream: str) -> str:
    """A stream's file: what a name cannot hold is escaped, and a first character that would hide it."""
    name = "%null" if stream == NULL else quote(stream, safe=" ")
    return f"{'%' + name[0].encode().hex().upper() + name[1:] if name[:1] in ('.', '_') else name}.wav"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]  # name and bytes


@dataclass
class Open:
    """A file that is being written: sorted pieces (first frame, last frame, place, bytes)."""

    path: str
    channels: int
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    frames: int = 0


class WavWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "s16"), overwrite
        self.rate, self.container, self.job = int(options.get("rate", 44100)), options.get("container", "riff"), uuid.uuid4().hex
        self.promised = int(options["frames"]) if "frames" in options else None
        checked_format(self.kind, 1, self.rate, self.container)
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        # An attempt of a task has files of its own; those of failed ones go with the job.
        streams, attempt = {}, uuid.uuid4().hex[:8]
        for batch in batches:
            names = batch.column("stream").cast(pa.string()).fill_null(NULL).dictionary_encode()
            codes, places = names.indices.to_numpy(zero_copy_only=False), batch.column("frame_idx").to_numpy(zero_copy_only=False)
            samples = batch.column("samples")
            for code, name in enumerate(names.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                own = own[np.argsort(places[own], kind="stable")]
                values = samples.take(pa.array(own))
                widths = np.unique(values.value_lengths().to_numpy(zero_copy_only=False))
                if name not in streams:
                    streams[name] = Open(f"{self.path}/_{self.job}.{attempt}.{len(streams)}", int(widths[0]))
                    checked_format(self.kind, streams[name].channels, self.rate, self.container)
                self.append(name, streams[name], places[own], widths, values.flatten())
        return Written([self.close(name, s) for name, s in streams.items()])

    def append(self, name: str, s: Open, places: np.ndarray, widths: np.ndarray, values: pa.Array) -> None:
        if len(widths) != 1 or int(widths[0]) != s.channels or values.null_count:
            raise ValueError(f"stream {name}: all frames must have {s.channels} samples")
        if not (np.diff(places) > 0).all():
            raise ValueError(f"stream {name}: a frame_idx comes twice")
        with open(s.path, "ab") as f:
            if not f.tell():
                f.write(self.head(s, self.promised or 0)[0])
            at = f.tell()
            f.write(pack(values.to_numpy(zero_copy_only=False), self.kind))
            s.runs.append((int(places[0]), int(places[-1]), at, f.tell() - at))
        s.frames += len(places)

    def head(self, s: Open, frames: int) -> tuple[bytes, bytes]:
        return wav_frame(frames * len(pack(np.zeros(s.channels), self.kind)), self.kind, s.channels, self.rate, self.container)

    def close(self, name: str, s: Open) -> tuple[str, int]:
        if self.promised is not None and self.promised != s.frames:
            raise ValueError(f"stream {name}: {self.promised} frames were promised and {s.frames} came")
        runs = sorted(s.runs)
        if any(b[0] <= a[1] for a, b in zip(runs, runs[1:], strict=False)):
            raise ValueError(f"stream {name}: sort the rows by stream and frame_idx within partitions, with no frame_idx twice")
        head, tail = self.head(s, s.frames)
        if runs != s.runs:
            with open(s.path, "rb") as old, open(f"{s.path}.new", "wb") as new:
                new.write(head)
                for _, _, at, n in runs:
                    old.seek(at)
                    for k in range(0, n, 1 << 20):
                        new.write(old.read(min(1 << 20, n - k)))
            os.replace(f"{s.path}.new", s.path)
        with open(s.path, "r+b") as f:
            if self.promised is None:
                f.write(head)
            f.seek(0, os.SEEK_END)
            f.write(tail)
            size = f.tell()
        final = f"_{self.job}.{file_name(name)}"
        os.replace(s.path, f"{self.path}/{final}")
        return final, size

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({n for n, _ in files}) != len(files):
            raise ValueError("a stream lies in several partitions; repartition by it before writing")
        for name, size in files:
            if os.path.getsize(f"{self.path}/{name}") != size:
                raise ValueError(f"{name} has not the {size} bytes that were written")
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.path)}/*"):
                if not os.path.basename(old).startswith("_"):
                    shutil.rmtree(old) if os.path.isdir(old) else os.remove(old)
        for name, _ in files:
            os.replace(f"{self.path}/{name}", f"{self.path}/{name.removeprefix(f'_{self.job}.')}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        for f in glob.glob(f"{glob.escape(self.path)}/_{self.job}.*"):
            os.remove(f)


class WavDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return f"path string, frame_idx bigint, samples array<{VALUE[self.options.get('target', 's16')]}>"

    def reader(self, schema: StructType) -> WavReader:
        return WavReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter({k.lower(): v for k, v in self.options.items()}, overwrite)
