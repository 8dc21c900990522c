"""Offsets, seek indexes and joins on frame positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_frames(frames: DataFrame, first: int = 0, count: int | None = None, order: str = "frame_idx") -> DataFrame:
    """Frames [first, first + count): a filter, which sources with pushdown turn into a byte range."""
    out = frames.where(F.col(order) >= first)
    return out if count is None else out.where(F.col(order) < first + count)


def seek_clamped(frames: DataFrame, target: Column, total: Column, order: str = "frame_idx") -> DataFrame:
    """Frames from ``target`` on; a target beyond the end stands at the end and gives none."""
    return frames.where(F.col(order) >= F.least(target, total))


def trim(frames: DataFrame, delay: Column, padding: Column, total: Column, order: str = "frame_idx") -> DataFrame:
    """Frames without the encoder's delay at the head and padding at the tail, numbered anew."""
    return frames.where((F.col(order) >= delay) & (F.col(order) < total - padding)).withColumn(order, F.col(order) - delay)


#: A whole number of every rate that MPEG audio has.
RATE_UNITS = 14_112_000


def running_pcm(mp3_frames: DataFrame, key: str = "path", rate: Column | None = None) -> DataFrame:
    """``mp3_frames`` with ``pcm_idx``, the first PCM frame of each.

    With ``rate``, the rate that a stream is resampled to, ``pcm_idx`` counts PCM frames of that rate. What is left of a frame is carried
    on exactly, in whole units, where streams change their ``sample_rate``.
    """
    before = Window.partitionBy(key).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    if rate is None:
        return mp3_frames.withColumn("pcm_idx", F.coalesce(F.sum("pcm_frames").over(before), F.lit(0)))
    units = F.col("pcm_frames").cast("long") * rate.cast("long") * F.floor(F.lit(RATE_UNITS) / F.col("sample_rate")).cast("decimal(20,0)")
    carried = F.coalesce(F.sum(units).over(before), F.lit(0))
    return mp3_frames.withColumn("pcm_idx", F.floor(carried / RATE_UNITS).cast("long"))


def counts(mp3_frames: DataFrame, key: str = "path") -> DataFrame:
    """Frames and PCM frames of each stream, as counted by walking it."""
    return mp3_frames.groupBy(key).agg(F.count("*").alias("mp3_frames"), F.sum("pcm_frames").cast("long").alias("pcm_frames"))


def pcm_total(counted: Column, tagged: Column, delay: Column, padding: Column) -> Column:
    """The tagged total without delay and padding, or else what was counted, untrimmed."""
    return F.coalesce(F.greatest(tagged - delay - padding, F.lit(0)), counted)


def seek_index(mp3_frames: DataFrame, points: int, key: str = "path") -> DataFrame:
    """``key, point, seek_pos_bytes, pcm_frame_index, mp3_frames_to_discard, pcm_frames_to_discard``.

    Every frame knows the evenly spaced targets inside it from its stream's totals, by windows over one shuffle by
    stream. Streams of fewer than three frames get one point at their start.
    """
    by_stream, whole = Window.partitionBy(key).orderBy("frame_no"), Window.partitionBy(key)
    placed = running_pcm(mp3_frames, key).withColumns({
        # Two frames lead in: the third frame at least is where the discarding starts to count.
        "lead_pos": F.lag("byte_pos", 2).over(by_stream),
        "lead_pcm": F.lag("pcm_idx", 1).over(by_stream),
        "end": F.col("pcm_idx") + F.col("pcm_frames"),
        "n": F.count("*").over(whole),
        "total": F.sum("pcm_frames").over(whole),
        "start": F.max(F.when(F.col("frame_no") == 0, F.col("byte_pos"))).over(whole),
        "second": F.max(F.when(F.col("frame_no") == 1, F.col("pcm_idx"))).over(whole),
    })
    frames = placed.withColumn("points", F.least(F.lit(points), F.col("n") - 1)).withColumn("space", F.floor(F.col("total") / (F.col("points") + 1)))
    # Targets inside a frame: k * space in [pcm_idx, end), k from 1 to points; a short stream has one at its first frame.
    short = F.col("n") < 3
    low = F.greatest(F.ceil(F.try_divide(F.col("pcm_idx"), F.col("space"))), F.lit(1))
    high = F.least(F.ceil(F.try_divide(F.col("end"), F.col("space"))) - 1, F.col("points").cast("long"))
    ks = F.when(short, F.when(F.col("frame_no") == 0, F.array(F.lit(1).cast("long")))).when(low <= high, F.sequence(low, high))
    inside = frames.withColumn("k", F.explode(ks))
    pos, pcm = F.when(F.col("frame_no") < 2, F.col("start")).otherwise(F.col("lead_pos")), F.when(F.col("frame_no") < 2, F.col("second")).otherwise(F.col("lead_pcm"))
    target, none = F.col("k") * F.col("space"), F.lit(0)

    def unless_short(value: Column, kind: str) -> Column:
        return F.when(short, none.cast(kind)).otherwise(value.cast(kind))

    return inside.select(
        key, F.col("k").cast("int").alias("point"), unless_short(pos, "bigint").alias("seek_pos_bytes"), unless_short(target, "bigint").alias("pcm_frame_index"),
        unless_short(F.lit(2), "int").alias("mp3_frames_to_discard"), unless_short(F.pmod(target - pcm, F.lit(65536)), "int").alias("pcm_frames_to_discard"),
    )


def asof_backward(targets: DataFrame, points: DataFrame, key: str, at: str, point_at: str, width: int | None = None) -> DataFrame:
    """``targets`` with the closest point at or before each, as a struct ``point`` (null before the first).

    Both sides are sorted together once for each key: no pair of a target with all points ever exists. With ``width``,
    a key is cut into ranges of so many positions, each sorted in a task of its own with the last point before it carried in,
    so one long stream is no single task.
    """
    bin_ = F.floor(F.col("_at") / width) if width else F.lit(0)
    t = targets.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*targets.columns).alias("_target"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point")).withColumn("_bin", bin_)
    p = points.select(F.col(key).alias("_k"), F.col(point_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(t.schema["_target"].dataType).alias("_target"), F.struct(*points.columns).alias("_point")).withColumn("_bin", bin_)
    upto = Window.partitionBy("_k", "_bin").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = t.union(p).withColumn("_last", F.last("_point", ignorenulls=True).over(upto)).where("_side = 1")
    if width:
        earlier = Window.partitionBy("_k").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        lasts = p.groupBy("_k", "_bin").agg(F.max(F.struct("_at", "_point"))["_point"].alias("_own"))
        bins = lasts.unionByName(t.select("_k", "_bin").distinct().withColumn("_own", F.lit(None).cast(p.schema["_point"].dataType)))
        bins = bins.groupBy("_k", "_bin").agg(F.max("_own").alias("_own")).withColumn("_carried", F.last("_own", ignorenulls=True).over(earlier))
        met = met.join(bins.drop("_own"), ["_k", "_bin"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return met.select("_target.*", F.col("_last").alias("point"))


def labels_with_cues(metadata: DataFrame, key: str = "path") -> DataFrame:
    """Labels, notes and regions with the sample offset of the cue point that they name.

    Points and names of a stream meet in one sort of its metadata, which is worked out once; of points with one id the latest in the stream counts.
    """
    named = F.col("type").isin("label", "note", "region")
    points = F.transform("cue.points", lambda x: F.struct(x["id"].alias("id"), x["sample_offset"].alias("offset")))
    marks = F.when(F.col("type") == "cue", points).when(named, F.array(F.struct(F.col("cue_point_id").alias("id"), F.lit(None).cast("bigint").alias("offset"))))
    # Of a row of points nothing else is carried along.
    kept = [F.col(c) if c in (key, "type") else F.when(named, F.col(c)).alias(c) for c in metadata.columns]
    spread = metadata.where(F.col("type").isin("cue", "label", "note", "region")).select(*kept, F.explode(marks).alias("_mark"))
    met = spread.withColumn("sample_offset", F.max("_mark.offset").over(Window.partitionBy(key, "_mark.id")))
    return met.where(F.col("type") != "cue").drop("_mark")


def frames_in_regions(frames: DataFrame, regions: DataFrame, key: str = "path", width: int = 1 << 14) -> DataFrame:
    """Frames with the regions ``[start, start + length)`` that hold them.

    An interval join as an equality join: frames and regions meet in bins of ``width`` frames.
    """
    left = frames.withColumn("_bin", F.floor(F.col("frame_idx") / width))
    right = regions.where("length > 0").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length") - 1) / width))))
    inside = (F.col("frame_idx") >= F.col("start")) & (F.col("frame_idx") < F.col("start") + F.col("length"))
    return left.join(right, [key, "_bin"]).where(inside).drop("_bin")


def differences(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Rows of two decodings that are not equal, or that one of them lacks."""
    both = a.select(*on, F.col(value).alias("a")).join(b.select(*on, F.col(value).alias("b")), on, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))
