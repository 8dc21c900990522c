import os
import struct
from collections import Counter

import numpy as np
import pytest

from echolith import api
from echolith.operators.encode import encode_wav, join_metadata, pack, with_metadata
from echolith.operators.seek import limit_frames, seek_clamped
from echolith.sources.codecs import decode
from echolith.sources.tables import audio_metadata, container_of
from pyspark.sql import functions as F


def test_read_decode_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ramp = np.arange(-50, 50)
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.wav").write_bytes(encode_wav(pack(ramp, "s16"), "s16", 1, 8000))
    audio = api.read_audio(spark, str(tmp_path / "in"), "*.wav")
    frames = api.decode_audio(audio)
    assert frames.count() == 200 and api.decode_audio(audio, first=90, count=20).count() == 20
    named = frames.withColumn("stream", F.regexp_extract("path", r"(\w)\.wav", 1))
    api.write_audio(named, str(tmp_path / "out"), rate=8000)
    again = api.decode_audio(api.read_audio(spark, str(tmp_path / "out"), "[ab].wav"))
    assert sorted(r.samples[0] for r in again.collect()) == sorted([*ramp.tolist(), *ramp.tolist()])
    assert limit_frames(again, 10, 5).count() == 10 and seek_clamped(again, F.lit(1000), F.lit(100)).count() == 0
    assert {r.c for r in audio.select(container_of(F.col("content")).alias("c")).collect()} == {"riff"}
    (tmp_path / "in" / "broken.wav").write_bytes(b"RIFF")
    everything = api.read_audio(spark, str(tmp_path / "in"))
    assert api.decode_audio(everything).count() == 200
    with pytest.raises(Exception, match="broken"):
        api.decode_audio(everything, strict=True).count()
    assert "Exchange" not in api.decode_audio(everything, strict=True)._jdf.queryExecution().executedPlan().toString()


def test_metadata_joins_its_stream(spark):
    content = encode_wav(pack(np.arange(10), "s16"), "s16", 1, 8000)
    files = spark.createDataFrame([("x", content), ("y", content)], "stream string, content binary")
    rows = spark.createDataFrame([("x", "title", None, "T"), ("x", "label", 1, "L")], "stream string, type string, cue_point_id long, text string")
    got = audio_metadata(join_metadata(files, rows), "stream")
    assert {(r.stream, r.type, r.text) for r in got.collect()} == {("x", "title", "T"), ("x", "label", "L")}


def test_metadata_stays_beside_what_is_joined(spark):
    from echolith.sources.containers import parse
    from tests.test_containers import METADATA

    ramp = np.arange(40)
    files = {c: encode_wav(pack(ramp, "s16"), "s16", 2, 8000, c, METADATA) for c in ("riff", "rf64")}
    files |= {k: encode_wav(pack(ramp % 256, k), k, 1, 8000) for k in ("alaw", "mulaw", "u8", "f64")}
    body = b"WAVE" + b"fmt " + struct.pack(">IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack(">I", 80) + pack(ramp, "s16", big=True)
    files["rifx"] = b"RIFX" + struct.pack(">I", len(body)) + body
    body = b"AIFF" + b"COMM" + struct.pack(">IHIH", 18, 1, 40, 16) + bytes.fromhex("400BFA00000000000000") + b"SSND" + struct.pack(">III", 88, 0, 0) + pack(ramp, "s16", big=True)
    files["aiff"] = b"FORM" + struct.pack(">I", len(body)) + body
    given = spark.createDataFrame(list(files.items()), "stream string, content binary")
    # All that the first file has, as the table of metadata shows it, joined to every other one.
    rows = audio_metadata(given.where("stream = 'riff'"), "stream").drop("stream").crossJoin(given.where("stream <> 'riff'").select("stream"))
    made = {r.stream: r.content for r in join_metadata(given, rows).collect()}
    own = [(m["type"], m.get("text"), m.get("cue_point_id"), m["raw"]) for m in parse(files["riff"]).metadata]
    for stream, content in made.items():
        before, after = parse(files[stream]), parse(content)
        times = 1 if stream in ("riff", "f64", "u8", "alaw", "mulaw", "rifx", "aiff") else 2
        assert Counter((m["type"], m.get("text"), m.get("cue_point_id"), m["raw"]) for m in after.metadata) == Counter(own * times), stream
        assert after.status == "ok" and after.total_pcm_frames == before.total_pcm_frames
        assert (decode(after, content) == decode(before, files[stream])).all()
    w64 = encode_wav(pack(ramp, "s16"), "s16", 1, 8000, "w64")
    with pytest.raises(ValueError, match="Wave64"):
        with_metadata(w64, [{"type": "title", "text": "T"}])
    with pytest.raises(ValueError, match="unknown metadata"):
        with_metadata(files["riff"], [{"type": "colour"}])


def test_files_are_written_as_promised(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("a/b", i, [i, -i]) for i in range(900)] + [("c", i, [i, 0]) for i in range(5)] + [("..", 0, [1, 2]), (None, 0, [3, 4])]
    df = spark.createDataFrame(rows, "stream string, frame_idx long, samples array<int>")
    api.write_audio(df, out, rate=8000)
    assert sorted(os.listdir(out)) == ["%2E..wav", "%null.wav", "a%2Fb.wav", "c.wav"]
    api.write_audio(df.where("stream = 'c'"), out, rate=8000, mode="overwrite")
    assert os.listdir(out) == ["c.wav"] and api.decode_audio(api.read_audio(spark, out)).count() == 5

    def write(rows, **options):
        rows.coalesce(1).write.format("wav").options(path=str(tmp_path / "more"), **options).mode("append").save()

    # Pieces in the wrong order are put right; promised counts, widths and numbers are checked.
    mixed = df.where("stream = 'a/b'").coalesce(1)
    write(mixed.where("frame_idx >= 400").union(mixed.where("frame_idx < 400")).coalesce(1))
    got = api.decode_audio(api.read_audio(spark, str(tmp_path / "more"))).orderBy("frame_idx").collect()
    assert [r.samples for r in got] == [[i, -i] for i in range(900)]
    write(df.where("stream = 'c'"), frames=5)
    for bad, options in (
        (df.where("stream = 'c'"), {"frames": 6}),
        (df.where("stream = 'c'").union(df.where("stream = 'c'")), {}),
        (spark.createDataFrame([("x", 0, [1]), ("x", 1, [1, 2])], df.schema), {}),
        (spark.createDataFrame([("x", 0, [1, None])], df.schema), {}),
        (df, {"kind": "ms_adpcm"}), (df, {"kind": "extensible"}), (df, {"kind": "s48"}), (df, {"container": "aiff"}), (df, {"rate": 0}),
    ):
        with pytest.raises(Exception, match="promised|twice|samples|written|unknown|writable|range"):
            write(bad, **options)
    assert sorted(os.listdir(tmp_path / "more")) == ["a%2Fb.wav", "c.wav"]


def test_many_files_are_planned_by_size(spark, tmp_path, monkeypatch):
    api.register(spark)
    ramp = np.arange(300)
    for k in range(70):
        (tmp_path / f"{k:02}.wav").write_bytes(encode_wav(pack(ramp + k, "s16"), "s16", 1, 8000))
    adpcm = b"".join(struct.pack("<hBB", 0, 0, 0) + bytes(range(32)) for _ in range(20))
    form = struct.pack("<HHIIHH", 17, 1, 8000, 4000, 36, 4)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(adpcm)) + adpcm
    (tmp_path / "z.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    want = sorted((r.path.rsplit("/", 1)[1], r.frame_idx, r.samples[0]) for r in api.decode_audio(api.read_audio(spark, str(tmp_path))).collect())
    for size in (100, 250, 1 << 20):
        read = spark.read.format("wav").option("path", str(tmp_path)).option("bytesPerPartition", size).load()
        assert sorted((r.path.rsplit("/", 1)[1], r.frame_idx, r.samples[0]) for r in read.collect()) == want
    assert read.where("frame_idx >= 290 and frame_idx < 295").count() == 71 * 5
    assert read.where(F.col("path") == str(tmp_path / "07.wav")).count() == 300
