"""One-call readers and writers.

    audio = echolith.api.read_audio(spark, "/data/clips", glob="*.wav")
    frames = echolith.api.decode_audio(audio, "f32")
    echolith.api.write_audio(frames, "/data/out", kind="f32", rate=16000)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.operators.encode import encode_streams
from echolith.sources import tables
from echolith.sources.wav_source import WavDataSource


def read_audio(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """The files of a folder, as ``path, modificationTime, length, content``."""
    return tables.read_files(spark, path, glob, recursive)


def decode_audio(audio: DataFrame, target: str = "s16", first: int = 0, count: int | None = None, strict: bool = False, key: str = "path") -> DataFrame:
    """``key, frame_idx, samples`` of every readable file; ``strict`` fails on the first that is not."""
    return tables.audio_frames(audio, target, first, count, key, strict)


def decode_mpeg(audio: DataFrame, target: str = "s16", first: int = 0, count: int | None = None, strict: bool = False, key: str = "path") -> DataFrame:
    """``key, frame_idx, samples`` of MPEG audio of Layers I and II, as s16 or f32."""
    return tables.mpeg_audio(audio, target, first, count, key, strict)


def encode_audio(frames: DataFrame, kind: str = "s16", rate: int = 44100, container: str = "riff", key: str = "path") -> DataFrame:
    """``key, content``: one container a stream, as a BINARY column."""
    return encode_streams(frames, kind, rate, container, key)


def write_audio(frames: DataFrame, path: str, kind: str = "s16", rate: int = 44100, container: str = "riff", key: str = "stream", mode: str = "append") -> None:
    """One file a stream (columns ``key, frame_idx, samples``), named by it; ``mode`` is append or overwrite."""
    named = frames.select(F.col(key).cast("string").alias("stream"), "frame_idx", "samples")
    frames.sparkSession.dataSource.register(WavDataSource)
    sorted_ = named.repartition("stream").sortWithinPartitions("stream", "frame_idx")
    sorted_.write.format("wav").option("path", path).option("kind", kind).option("rate", rate).option("container", container).mode(mode).save()


def register(spark: SparkSession) -> None:
    """The ``wav`` format, with the session's setting that lets filters reach it, and the SQL table functions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavDataSource)
    tables.register(spark)
