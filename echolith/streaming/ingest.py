"""Audio as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echolith.sources.mpeg import FREE_BYTES, HEADER, SYNC_FRAMES, Header, frames

#: Bytes that a live stream holds back at most: a sync is believed by the frames behind it.
KEPT = (SYNC_FRAMES + 2) * FREE_BYTES
FILE = "path string, modificationTime timestamp, length bigint, content binary"
FRAMES = "stream string, frame_no bigint, byte_pos bigint, frame_bytes int, channels int, sample_rate int, pcm_frames int"


def stream_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """New files of a folder, each once, as rows that every table function of ``sources.tables`` takes."""
    reader = spark.readStream.format("binaryFile").schema(FILE)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def live_mp3_frames(chunks: DataFrame) -> DataFrame:
    """Frames of live streams that arrive in pieces (columns ``stream, seq, bytes``), as soon as they are whole.

    The state of a stream is its unread bytes (``KEPT`` at most), where they stand in it, and the frames so far. A frame is
    given out once the header behind it has arrived, so a last frame waits for more. Pieces of one
    micro-batch may come in any order; over batches they must come in that of ``seq``.
    """

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data, base, count = (bytes(state.get[0]), *state.get[1:]) if state.exists else (b"", 0, 0)
        found = pd.concat(list(pieces)).sort_values("seq")
        data += b"".join(bytes(x) for x in found["bytes"])
        rows, used = [], 0
        for pos, n, h, pcm in frames(data):
            if pos + n + HEADER > len(data) or not h.like(Header.at(data, pos + n)):
                break
            rows.append((key[0], count, base + pos, n, h.channels, h.rate, pcm))
            count, used = count + 1, pos + n
        # A frame that begins before the last ``KEPT`` bytes had all that it needs to be believed.
        used = max(used, len(data) - KEPT)
        state.update((data[used:], base + used, count))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")])

    return chunks.groupBy("stream").applyInPandasWithState(step, FRAMES, "rest binary, base bigint, n bigint", "append", GroupStateTimeout.NoTimeout)



def write_stream(frames: DataFrame, path: str, checkpoint: str, kind: str = "s16", rate: int = 44100, container: str = "riff"):
    """Starts a query that writes the streams of each micro-batch as files of their own, ``<stream>-<batch>.wav``.

    A batch that is run again replaces its own files.
    """
    from pyspark.sql import functions as F

    from echolith.api import write_audio

    def batch(df: DataFrame, number: int) -> None:
        named = df.withColumn("stream", F.concat_ws("-", F.col("stream").cast("string"), F.lit(str(number))))
        write_audio(named, path, kind, rate, container)

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
