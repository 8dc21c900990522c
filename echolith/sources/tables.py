"""Directories or BINARY columns of audio as tables.

Each function takes a DataFrame with a key and a ``content`` column, as ``read_files`` gives, and returns
rows for each file: one pass over the contents, no shuffle. Malformed contents never fail a query; they
have a ``status``. The same tables are table functions in SQL after ``register``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from echolith.functions import headers
from echolith.sources.codecs import BLOCKS, decode, decode_blocks, frames_per_block, little
from echolith.sources.containers import Audio, parse
from echolith.sources.mpeg import frames, open_stream
from echolith.sources.mpeg_audio import decoded
from echolith.sources.rows import from_content, pcm_from

#: ADPCM blocks that travel together.
TOGETHER = 32
VALUE = {"s16": "smallint", "s32": "int", "f32": "float"}
FILES = "container string, format_tag int, channels int, sample_rate bigint, avg_bytes bigint, block_align int, bits_per_sample int, valid_bits int, channel_mask bigint, sub_format binary, data_pos bigint, data_size bigint, total_pcm_frames bigint, big_endian boolean, status string"
CHUNKS = "idx int, id binary, offset bigint, size bigint, padding int"
METADATA = (
    "idx int, type string, text string, cue_point_id bigint, "
    "smpl struct<manufacturer:bigint,product:bigint,sample_period:bigint,midi_note:bigint,midi_fraction:bigint,smpte_format:bigint,smpte_offset:bigint,"
    "loops:array<struct<cue_point_id:bigint,type:bigint,first:bigint,last:bigint,fraction:bigint,play_count:bigint>>,data:binary>, "
    "cue struct<count:bigint,points:array<struct<id:bigint,position:bigint,chunk_id:binary,chunk_start:bigint,block_start:bigint,sample_offset:bigint>>>, "
    "inst struct<midi_note:int,fine_tune:int,gain:int,low_note:int,high_note:int,low_velocity:int,high_velocity:int>, "
    "acid struct<flags:bigint,root_note:int,reserved1:int,reserved2:float,beats:bigint,meter_denominator:int,meter_numerator:int,tempo:float>, "
    "bext struct<description:string,originator:string,originator_reference:string,origination_date:string,origination_time:string,time_reference:decimal(20,0),version:int,umid:binary,coding_history:string,loudness_value:int,loudness_range:int,max_true_peak:int,max_momentary:int,max_short_term:int>, "
    "region struct<cue_point_id:bigint,sample_length:bigint,purpose:binary,country:int,language:int,dialect:int,code_page:int>, "
    "id binary, location string, raw binary"
)
TAGS = "idx int, type string, raw binary"
MP3_INFO = "channels int, sample_rate int, start bigint, end bigint, tagged_frames bigint, total_pcm_frames bigint, delay int, padding int, is_vbr boolean, is_cbr boolean, status string"
MP3_FRAMES = "frame_no bigint, byte_pos bigint, frame_bytes int, channels int, sample_rate int, layer int, bitrate_kbps int, pcm_frames int"


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length, content``; unused columns are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _file_row(content: bytes, sequential: bool = False) -> Iterator[tuple]:
    a = parse(content, sequential, metadata=False)
    yield tuple(getattr(a, c.split()[0]) for c in FILES.split(", "))


def _chunk_rows(content: bytes) -> Iterator[tuple]:
    for k, c in enumerate(parse(content, metadata=False).chunks):
        yield k, c["id"], c["offset"], c["size"], c["padding"]


def _metadata_rows(content: bytes) -> Iterator[tuple]:
    from decimal import Decimal

    names = ("type", "text", "cue_point_id", "smpl", "cue", "inst", "acid", "bext", "region", "id", "location", "raw")
    for k, m in enumerate(parse(content).metadata):
        if "bext" in m:
            m = m | {"bext": m["bext"] | {"time_reference": Decimal(m["bext"]["time_reference"])}}
        yield k, *(m.get(n) for n in names)


def _tag_rows(content: bytes) -> Iterator[tuple]:
    for k, t in enumerate(open_stream(content).tags):
        yield k, t["type"], t["raw"]


def _mp3_row(content: bytes) -> Iterator[tuple]:
    s = asdict(open_stream(content))
    yield tuple(s[c.split()[0]] for c in MP3_INFO.split(", "))


def _mp3_frame_rows(content: bytes) -> Iterator[tuple]:
    s = open_stream(content)
    if s.status == "ok":
        for k, (pos, n, h, pcm) in enumerate(f for f in frames(content, s.start, s.end) if f[3]):
            yield k, pos, n, h.channels, h.rate, h.layer, h.kbps, pcm


def audio_files(df: DataFrame, key: str = "path", sequential: bool = False) -> DataFrame:
    """One row for each file: its format, where its samples are, how many, and whether they can be read."""
    return from_content(df, key, FILES, lambda c: _file_row(c, sequential))


def audio_chunks(df: DataFrame, key: str = "path") -> DataFrame:
    return from_content(df, key, CHUNKS, _chunk_rows)


def audio_metadata(df: DataFrame, key: str = "path", types: list[str] | None = None) -> DataFrame:
    """One row for each metadata item; ``types`` keeps some kinds only."""
    out = from_content(df, key, METADATA, _metadata_rows, size=256)
    return out.where(F.col("type").isin(types)) if types else out


def audio_tags(df: DataFrame, key: str = "path") -> DataFrame:
    return from_content(df, key, TAGS, _tag_rows, size=64)


def mp3_info(df: DataFrame, key: str = "path") -> DataFrame:
    return from_content(df, key, MP3_INFO, _mp3_row)


def mp3_frames(df: DataFrame, key: str = "path") -> DataFrame:
    """One row for each frame that decodes to samples; a Xing or Info frame is none."""
    return from_content(df, key, MP3_FRAMES, _mp3_frame_rows)


def _frame_rows(content: bytes, target: str, first: int, count: int | None) -> Iterator[tuple]:
    pcm = decode(parse(content, metadata=False), content, target, first, count)
    for k, frame in enumerate(pcm.tolist()):
        yield first + k, frame


def audio_frames(df: DataFrame, target: str = "s16", first: int = 0, count: int | None = None, key: str = "path", strict: bool = False) -> DataFrame:
    """``key, frame_idx, samples``: PCM frames [first, first + count) of every file, as s16, s32 or f32.

    The bounds go into the decoder, which reads the bytes of those frames only (whole blocks for ADPCM). ``strict``
    fails on the first file that cannot be read, in the same pass.
    """

    def work(rows: list[dict]) -> Iterator[tuple]:
        for row in rows:
            audio = parse(row["content"], metadata=False)
            if strict and audio.status != "ok":
                raise ValueError(f"{row[key]}: {audio.status}")
            yield row[key], first, decode(audio, row["content"], target, first, count)

    return pcm_from(df, key, VALUE[target], ("content",), work)


def mpeg_audio(df: DataFrame, target: str = "s16", first: int = 0, count: int | None = None, key: str = "path", strict: bool = False) -> DataFrame:
    """``key, frame_idx, samples``: PCM frames [first, first + count) of MPEG audio of Layers I and II, as s16 or f32.

    Tags are left out, and nothing far before ``first`` is decoded. Layer III gives no rows; ``strict`` fails on
    the first file that is no MPEG audio or of Layer III.
    """

    def work(rows: list[dict]) -> Iterator[tuple]:
        for row in rows:
            s = open_stream(row["content"])
            layer = next((h.layer for *_, h, _ in frames(row["content"], s.start, s.end)), 0) if s.status == "ok" else 0
            if strict and layer not in (1, 2):
                raise ValueError(f"{row[key]}: {s.status if s.status != 'ok' else 'Layer III is not decoded'}")
            if layer in (1, 2):
                for at, pcm in decoded(row["content"], s.start, s.end, target, first, count):
                    yield row[key], at, pcm

    return pcm_from(df, key, VALUE[target], ("content",), work)


def audio_samples(df: DataFrame, target: str = "s16", first: int = 0, count: int | None = None, key: str = "path") -> DataFrame:
    """``key, frame_idx, ch`` and the sample, named like the target."""
    return audio_frames(df, target, first, count, key).select(key, "frame_idx", F.posexplode("samples").alias("ch", target))


def raw_data(df: DataFrame, key: str = "path", first: int = 0, count: int | None = None) -> DataFrame:
    """``key, raw``: the bytes of the samples as they are; ``first`` and ``count`` in bytes."""

    def rows(content: bytes) -> Iterator[tuple]:
        a = parse(content, metadata=False)
        if a.status == "ok":
            end = a.data_pos + (a.data_size if count is None else min(a.data_size, first + count))
            yield (content[a.data_pos + first : end],)

    return from_content(df, key, "raw binary", rows, size=16)


def native_data(df: DataFrame, key: str = "path", first: int = 0, count: int | None = None) -> DataFrame:
    """``key, raw``: the bytes of frames [first, first + count) in the file's own encoding, little-endian; none of ADPCM."""

    def rows(content: bytes) -> Iterator[tuple]:
        a = parse(content, metadata=False)
        if a.status == "ok" and a.tag not in (headers.MS_ADPCM, headers.IMA_ADPCM):
            last = a.total_pcm_frames if count is None else min(a.total_pcm_frames, first + count)
            raw = content[a.data_pos + first * a.frame_size : min(a.data_pos + last * a.frame_size, a.data_pos + a.data_size)]
            width = a.frame_size // a.channels
            yield (little(raw, width) if a.big_endian and width > 1 else raw,)

    return from_content(df, key, "raw binary", rows, size=16)


def pcm_bytes(df: DataFrame, target: str = "s16", big: bool = False, key: str = "path", first: int = 0, count: int | None = None) -> DataFrame:
    """``key, pcm``: the frames converted to ``target`` as interleaved bytes in the byte order asked for."""

    def rows(content: bytes) -> Iterator[tuple]:
        pcm = decode(parse(content, metadata=False), content, target, first, count)
        yield (pcm.astype(pcm.dtype.newbyteorder(">" if big else "<")).tobytes(),)

    return from_content(df, key, "pcm binary", rows, size=16)


def adpcm_frames(df: DataFrame, key: str = "path", partitions: int | None = None) -> DataFrame:
    """``key, frame_idx, samples`` of ADPCM files, block by block.

    Every block restates the decoder's state, so stretches of blocks of one long file are dealt out to all tasks.
    """
    blocks = from_content(df, key, "block_align int, channels int, tag int, frames bigint, block int, bytes binary", _blocks, size=64)
    dealt = blocks.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "block")

    def work(rows: list[dict]) -> Iterator[tuple]:
        formats: dict[tuple, list[dict]] = {}
        for row in rows:
            formats.setdefault((row["tag"], row["channels"], row["block_align"]), []).append(row)
        for (tag, channels, align), own in formats.items():
            a = Audio(format_tag=tag, channels=channels, block_align=align)
            cut = [(r, k, r["bytes"][k * align : (k + 1) * align]) for r in own for k in range(-(-len(r["bytes"]) // align))]
            for (row, k, _), pcm in zip(cut, decode_blocks(a, [x[2] for x in cut]), strict=True):
                at = (row["block"] + k) * frames_per_block(a)
                yield row[key], at, pcm[: max(0, row["frames"] - at)]

    return pcm_from(dealt, key, "smallint", ("bytes", "block", "block_align", "channels", "tag", "frames"), work, BLOCKS // TOGETHER)


def _blocks(content: bytes) -> Iterator[tuple]:
    """Stretches of ``TOGETHER`` blocks."""
    a = parse(content, metadata=False)
    if a.status == "ok" and a.tag in (headers.MS_ADPCM, headers.IMA_ADPCM):
        end = a.data_pos + a.data_size
        for k, at in enumerate(range(a.data_pos, end, TOGETHER * a.block_align)):
            yield a.block_align, a.channels, a.tag, a.total_pcm_frames, k * TOGETHER, content[at : min(end, at + TOGETHER * a.block_align)]


def container_of(content: Column) -> Column:
    """The container by its first bytes, without a UDF."""
    four = F.substring(content, 1, 4)
    kind = F.lit(None).cast("string")
    for name, tag in (("riff", b"RIFF"), ("rifx", b"RIFX"), ("rf64", b"RF64"), ("w64", b"riff"), ("aiff", b"FORM")):
        kind = F.when(four == F.lit(tag), name).otherwise(kind)
    return kind


def register(spark: SparkSession) -> None:
    """Makes ``audio_files``, ``audio_chunks``, ``audio_metadata``, ``audio_tags``, ``mp3_info``, ``mp3_frames`` and
    ``audio_frames`` table functions of SQL, for ``LATERAL`` joins on a BINARY column."""
    for name, schema, rows in (
        ("audio_files", FILES, _file_row), ("audio_chunks", CHUNKS, _chunk_rows), ("audio_metadata", METADATA, _metadata_rows),
        ("audio_tags", TAGS, _tag_rows), ("mp3_info", MP3_INFO, _mp3_row), ("mp3_frames", MP3_FRAMES, _mp3_frame_rows),
    ):
        spark.udtf.register(name, _udtf(rows, schema))

    class Frames:
        def eval(self, content: bytes, first: int, count: int):
            if content is not None:
                yield from _frame_rows(bytes(content), "f32", first, count)

    spark.udtf.register("audio_frames", udtf(Frames, returnType="frame_idx bigint, samples array<float>"))


def _udtf(rows, schema: str):
    class Rows:
        def eval(self, content: bytes):
            if content is not None:
                yield from rows(bytes(content))

    return udtf(Rows, returnType=schema)
