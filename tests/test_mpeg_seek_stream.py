"""MPEG tables, seeking, joins on positions and streams."""

import pytest

from echolith.operators import seek as K
from echolith.sources.mpeg import Header, frames, open_stream
from echolith.sources.tables import audio_tags, mp3_frames, mp3_info
from echolith.streaming.ingest import live_mp3_frames, stream_files

H = b"\xff\xfb\x90\x00"  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, stereo: 417 bytes
FRAME = H.ljust(417, b"\0")


def xing(frames_=50, delay=576, padding=1000, name=b"Xing"):
    body = name + bytes([0, 0, 0, 1]) + frames_.to_bytes(4, "big")
    lame = b"LAME3.100".ljust(21, b"\0") + ((delay << 12) | padding).to_bytes(3, "big") + bytes(12)
    return (H + bytes(32) + body + lame).ljust(417, b"\0")


def test_headers():
    h = Header.at(FRAME, 0)
    assert (h.layer, h.kbps, h.rate, h.samples, h.size(), h.padding, h.channels, h.side_info) == (3, 128, 44100, 1152, 417, 0, 2, 32)
    assert Header.at(b"\xff\xfb\xf0\x00", 0) is None and Header.at(b"\xff\xf9\x90\x00", 0) is None
    assert Header.at(b"\xff\xe3\x90\x00", 0).rate == 11025


def test_frames_tags_and_totals():
    audio = FRAME * 20
    tagged = b"ID3\x04\0\0\0\0\0\x0a" + bytes(10) + xing() + audio + (b"APETAGEX" + bytes(16) + bytes(8)) + b"TAG".ljust(128, b"x")
    s = open_stream(tagged)
    assert [t["type"] for t in s.tags] == ["id3v1", "ape", "id3v2", "xing"]
    assert (s.total_pcm_frames, s.delay, s.padding) == (50 * 1152, 576 + 529, 1000 - 529)
    assert len(list(frames(tagged, s.start, s.end))) == 20
    assert open_stream(audio).total_pcm_frames is None and open_stream(b"x" * 100).status == "no MPEG frame"
    assert open_stream(b"").status != "ok"
    assert [p for p, *_ in frames(b"junk" + audio[: 417 * 12])] == [4 + 417 * k for k in range(12)]
    assert open_stream(xing(name=b"Info") + audio).tags[0]["type"] == "vbri"
    needs = bytearray(FRAME)
    needs[4] = 0x80  # wants a reservoir of 256 bytes that a first frame has not
    assert [pcm for *_, pcm in frames(bytes(needs) + FRAME * 3)] == [0, 1152, 1152, 1152]


def test_truncated_streams_never_raise():
    tagged = b"ID3\x04\0\0\0\0\0\x0a" + bytes(10) + xing() + FRAME * 3 + b"TAG".ljust(128, b"x")
    for n in range(0, len(tagged), 13):
        s = open_stream(tagged[:n])
        list(frames(tagged[:n], s.start, s.end))


@pytest.fixture(scope="module")
def files(spark):
    rows = [("long", xing() + FRAME * 30), ("short", FRAME * 2), ("none", b"nothing at all"), ("null", None)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_tables_and_index(spark, files):
    assert {r.path: r.status for r in mp3_info(files).collect()} == {"long": "ok", "short": "ok", "none": "no MPEG frame"}
    assert audio_tags(files).count() == 1
    found = mp3_frames(files)
    assert {r.path: (r.mp3_frames, r.pcm_frames) for r in K.counts(found).collect()} == {"long": (30, 30 * 1152), "short": (2, 2304)}
    points = {(r.path, r.point): r for r in K.seek_index(found, 4).collect()}
    assert len(points) == 5 and points["short", 1].pcm_frame_index == 0
    space = 30 * 1152 // 5
    for k in range(1, 5):
        p, frame = points["long", k], max(k * space // 1152, 2)
        assert (p.pcm_frame_index, p.seek_pos_bytes) == (k * space, 417 + 417 * (frame - 2))
        assert p.pcm_frames_to_discard == k * space - 1152 * (frame - 1)


def test_asof_and_intervals(spark):
    t = spark.createDataFrame([("a", 5), ("a", 10), ("a", 1), ("b", 7)], "k string, at int")
    p = spark.createDataFrame([("a", 4), ("a", 10), ("c", 1)], "k string, p int")
    assert {(r.k, r.at): r.point.p if r.point else None for r in K.asof_backward(t, p, "k", "at", "p").collect()} == {("a", 5): 4, ("a", 10): 10, ("a", 1): None, ("b", 7): None}
    f = spark.range(100).selectExpr("'x' as path", "id as frame_idx")
    r = spark.createDataFrame([("x", 10, 5), ("x", 12, 50), ("x", 1, 0)], "path string, start long, length long")
    assert K.frames_in_regions(f, r, width=8).count() == 55
    assert K.differences(f, f.where("frame_idx <> 3"), ["path"], "frame_idx").count() >= 1


def test_asof_over_cut_keys(spark):
    import random

    rng = random.Random(3)
    targets = [(rng.choice("ab"), rng.randrange(1000)) for _ in range(300)] + [("c", 5)]
    points = [(rng.choice("ab"), rng.randrange(1000)) for _ in range(25)]
    t, p = spark.createDataFrame(targets, "k string, at int"), spark.createDataFrame(points, "k string, p int")
    want = sorted((k, at, max((x for own, x in points if own == k and x <= at), default=-1)) for k, at in targets)
    for width in (None, 10, 64, 5000):
        got = K.asof_backward(t, p, "k", "at", "p", width).collect()
        assert sorted((r.k, r.at, r.point.p if r.point else -1) for r in got) == want, width


def test_labels_take_the_offset_of_their_point(spark):
    schema = "path string, type string, text string, cue_point_id long, cue struct<points:array<struct<id:long,sample_offset:long>>>"
    rows = [("a", "cue", None, None, ([(1, 10), (2, 20), (2, 30)],)), ("a", "label", "x", 1, None), ("a", "note", "y", 2, None), ("a", "region", "z", 7, None), ("a", "title", "t", None, None), ("b", "label", "w", 1, None), ("b", "cue", None, None, None)]
    got = K.labels_with_cues(spark.createDataFrame(rows, schema)).collect()
    assert {(r.path, r.type, r.text, r.sample_offset) for r in got} == {("a", "label", "x", 10), ("a", "note", "y", 30), ("a", "region", "z", None), ("b", "label", "w", None)} and len(got) == 4


def test_live_state_stays_small(spark, tmp_path):
    from echolith.streaming import ingest

    source = tmp_path / "junk"
    schema = "stream string, seq long, bytes binary"
    pieces = [bytes(100_000)] * 6 + [FRAME * 30]
    for k, piece in enumerate(pieces):
        spark.createDataFrame([("s", k, bytearray(piece))], schema).coalesce(1).write.mode("append").parquet(str(source))
    live = live_mp3_frames(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(source)))
    q = live.writeStream.format("memory").queryName("live_junk").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert [r.byte_pos for r in spark.table("live_junk").orderBy("frame_no").collect()] == [600_000 + 417 * k for k in range(29)]
    state = spark.read.format("statestore").load(str(tmp_path / "cp3"))
    sizes = [len(x) for r in state.collect() for x in str(r.value).split("bytearray")]
    assert max(sizes) < 6 * ingest.KEPT


def test_file_stream_equals_batch(spark, files, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp3").write_bytes(FRAME * 12)
    got = mp3_frames(stream_files(spark, str(tmp_path / "in")))
    q = got.writeStream.format("memory").queryName("live_files").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live_files").count() == 12


def test_live_chunks_equal_the_whole(spark, tmp_path):
    data = FRAME * 25
    source = tmp_path / "chunks"
    schema = "stream string, seq long, bytes binary"
    for k, at in enumerate(range(0, len(data), 1000)):
        spark.createDataFrame([("s", k, bytearray(data[at : at + 1000]))], schema).coalesce(1).write.mode("append").parquet(str(source))
    live = live_mp3_frames(spark.readStream.schema(schema).option("maxFilesPerTrigger", 6).parquet(str(source)))
    q = live.writeStream.format("memory").queryName("live_chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = [r.byte_pos for r in spark.table("live_chunks").orderBy("frame_no").collect()]
    assert got == [417 * k for k in range(24)]


def test_stream_sink(spark, tmp_path):
    from echolith.api import decode_audio, read_audio
    from echolith.streaming.ingest import write_stream

    rows = spark.createDataFrame([("a", k, [k]) for k in range(50)], "stream string, frame_idx long, samples array<int>")
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    write_stream(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert decode_audio(read_audio(spark, str(tmp_path / "out"), "a-0.wav")).count() == 50
