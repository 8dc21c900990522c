"""Containers: every container with every encoding, oddities, metadata and malformed bytes."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.functions.headers import repaired_data_size
from echolith.operators.encode import CONTAINERS, encode_wav, pack
from echolith.sources import codecs
from echolith.sources.codecs import decode, frames_per_block
from echolith.sources.containers import Audio, _finish, extended, parse
from echolith.sources.tables import adpcm_frames, audio_files, audio_frames, audio_metadata, audio_samples, read_files, register

RAMP = np.arange(-60, 60, dtype=np.int64)


def values(kind):
    return {"u8": RAMP + 128, "f32": (RAMP / 64).astype(np.float32), "f64": RAMP / 64, "s24": RAMP * 70000, "s32": RAMP * 17000000, "alaw": RAMP % 256, "mulaw": RAMP % 256}.get(kind, RAMP * 500)


@pytest.mark.parametrize("container", CONTAINERS)
@pytest.mark.parametrize("kind", ["u8", "s16", "s24", "s32", "f32", "f64", "alaw", "mulaw"])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_round_trip(container, kind, channels):
    data = pack(values(kind), kind)
    audio = parse(content := encode_wav(data, kind, channels, 8000, container))
    assert (audio.status, audio.container, audio.channels, audio.total_pcm_frames) == ("ok", container, channels, len(RAMP) // channels)
    assert content[audio.data_pos : audio.data_pos + audio.data_size] == data
    if kind in ("s16", "f32"):
        assert decode(audio, content, kind).ravel().tolist() == values(kind).tolist()
    whole = decode(audio, content, "f32")
    parts = np.concatenate([decode(audio, content, "f32", k, 7) for k in range(0, len(whole), 7)])
    assert (whole == parts).all()


def aiff(kind=b"NONE", bits=16, data=b"", channels=1, frames=0, aifc=True, rate=0x400EAC44000000000000, ssnd_first=False, skip=0):
    comm = struct.pack(">HIH", channels, frames, bits) + rate.to_bytes(10, "big") + (kind + b"\0\0" if aifc else b"")
    sound = struct.pack(">II", skip, 0) + b"x" * skip + data
    chunks = [b"COMM" + struct.pack(">I", len(comm)) + comm + bytes(len(comm) % 2), b"SSND" + struct.pack(">I", len(sound)) + sound + bytes(len(sound) % 2)]
    body = (b"AIFC" if aifc else b"AIFF") + b"".join(reversed(chunks) if ssnd_first else chunks)
    return b"FORM" + struct.pack(">I", len(body)) + body


def test_aiff_and_aifc():
    big = pack(RAMP * 500, "s16", big=True)
    for content in (aiff(data=big, frames=120), aiff(data=big, frames=120, aifc=False), aiff(b"sowt", data=pack(RAMP * 500, "s16"), frames=120), aiff(data=big, frames=120, ssnd_first=True), aiff(data=big, frames=120, skip=6)):
        audio = parse(content)
        assert (audio.status, audio.sample_rate, audio.total_pcm_frames) == ("ok", 44100, 120)
        assert decode(audio, content).ravel().tolist() == (RAMP * 500).tolist()
    signed = (RAMP % 256).astype(np.uint8).tobytes()
    assert decode(parse(c := aiff(bits=8, data=signed, frames=120)), c).ravel().tolist() == (RAMP * 256).tolist()
    assert decode(parse(c := aiff(b"raw ", 8, pack(RAMP + 128, "u8"), frames=120)), c).ravel().tolist() == (RAMP * 256).tolist()
    assert parse(aiff(b"ima4", data=big)).status == "unsupported AIFC compression"
    assert parse(aiff(b"ALAW", 16, bytes(120), frames=120)).bits_per_sample == 8
    assert parse(aiff(bits=12, data=big, frames=120)).bits_per_sample == 16
    assert parse(aiff(data=big, frames=120, ssnd_first=True), sequential=True).status == "SSND before COMM"


def test_extended_floats():
    assert extended(bytes.fromhex("400EAC44000000000000")) == 44100
    assert extended(bytes.fromhex("3FFE8000000000000000")) == 0
    assert extended(bytes.fromhex("C00EAC44000000000000")) == -44100


def test_rifx_is_big_endian():
    form = struct.pack(">HHIIHH", 1, 1, 8000, 16000, 2, 16)
    content = b"RIFX" + bytes(4) + b"WAVE" + b"fmt " + struct.pack(">I", 16) + form + b"data" + struct.pack(">I", 240) + pack(RAMP * 500, "s16", big=True)
    assert decode(parse(content), content).ravel().tolist() == (RAMP * 500).tolist()


def riff(*chunks, size=0):
    return b"RIFF" + struct.pack("<I", size) + b"WAVE" + b"".join(n + struct.pack("<I", len(b) if s is None else s) + b + bytes(len(b) % 2) for n, b, s in chunks)


FMT = (b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16), None)


def test_header_oddities():
    data = pack(RAMP * 500, "s16")
    assert parse(riff((b"JUNK", b"12345", None), FMT, (b"data", data, None))).total_pcm_frames == 120
    assert parse(riff(FMT, (b"data", data, 0xFFFFFFFF))).data_size == 240
    assert parse(riff(FMT, (b"data", data, 9999))).data_size == 240
    assert parse(riff(FMT, (b"data", data[:-1], None))).total_pcm_frames == 119
    assert parse(riff(FMT, (b"fact", struct.pack("<I", 7), None), (b"data", data, None))).total_pcm_frames == 120
    guid = b"\x03\0\0\0\0\0\x10\0\x80\0\0\xaa\0\x38\x9b\x71"
    wide = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 32000, 4, 32, 22, 32, 4) + guid
    audio = parse(c := riff((b"fmt ", wide, None), (b"data", pack((RAMP / 64).astype(np.float32), "f32"), None)))
    assert (audio.tag, audio.channel_mask, audio.sub_format) == (3, 4, guid)
    assert decode(audio, c, "f32").ravel().tolist() == (RAMP / 64).astype(np.float32).tolist()


def test_size_repair_is_that_of_the_parser(spark):
    """On files beyond 4 GiB too, where 0xFFFFFFFF reaches to the end in RIFF and RIFX only."""
    rows = [(c, said, 44, size, 4) for c in (*CONTAINERS, "rifx", "aiff") for said in (0, 1001, 0xFFFFFFFE, 0xFFFFFFFF, 2**32, 2**33) for size in (0, 44, 1000, 2**32 + 42, 2**32 + 43, 2**32 + 44, 5 * 2**30 + 3)]
    want = []
    for container, said, at, size, _ in rows:
        _finish(audio := Audio(container=container, format_tag=1, channels=2, sample_rate=8000, bits_per_sample=16, block_align=4, data_pos=at, data_size=said), size)
        want.append(audio.data_size)
    said, at, size, frame, container = (F.col(c) for c in ("said", "at", "size", "frame", "container"))
    table = spark.createDataFrame([(*r, w) for r, w in zip(rows, want)], "container string, said bigint, at bigint, size bigint, frame int, want bigint")
    assert table.where(~repaired_data_size(said, at, size, frame, container).eqNullSafe(F.col("want"))).count() == 0
    for name in ("riff", "w64"):
        assert table.where(container == name).where(~repaired_data_size(said, at, size, frame, name).eqNullSafe(F.col("want"))).count() == 0
    assert {w for r, w in zip(rows, want) if r[1] == 0xFFFFFFFF and r[3] == 5 * 2**30 + 3} == {5 * 2**30 - 44, 2**32 - 4}


def test_malformed_bytes_have_a_status():
    good = encode_wav(pack(RAMP, "s16"), "s16", 2, 8000, "riff", [{"type": "title", "text": "t"}])
    w64 = encode_wav(pack(RAMP, "s16"), "s16", 2, 8000, "w64")
    for content in (good, w64, aiff(data=bytes(240), frames=120), encode_wav(pack(RAMP, "s16"), "s16", 2, 8000, "rf64")):
        for n in range(len(content)):
            audio = parse(content[:n])
            assert audio.status != "ok" or audio.data_pos + audio.data_size <= n
            decode(audio, content[:n])
    for change in ((20, 15), (22, 0), (24, 0), (32, 0)):
        bad = bytearray(good)
        bad[change[0]] = change[1]
        parse(bytes(bad))
    rng = np.random.default_rng(3)
    for _ in range(500):
        bad = bytearray(good)
        for k in rng.integers(0, len(bad), 4):
            bad[k] = rng.integers(0, 256)
        audio = parse(bytes(bad))
        decode(audio, bytes(bad))
    assert parse(b"").status == "unknown container"
    assert parse(riff((b"fmt ", FMT[1][:14], None), (b"data", b"", None))).status == "fmt below 16 bytes"


METADATA = [
    {"type": "smpl", "smpl": {"manufacturer": 1, "product": 2, "sample_period": 3, "midi_note": 60, "midi_fraction": 0, "smpte_format": 0, "smpte_offset": 0, "loops": [{"cue_point_id": 1, "type": 0, "first": 5, "last": 9, "fraction": 0, "play_count": 2}], "data": b"own!"}},
    {"type": "inst", "inst": {"midi_note": 60, "fine_tune": -3, "gain": 4, "low_note": 0, "high_note": 127, "low_velocity": 1, "high_velocity": 127}},
    {"type": "cue", "cue": {"points": [{"id": 1, "position": 0, "chunk_id": b"data", "chunk_start": 0, "block_start": 0, "sample_offset": 5}]}},
    {"type": "acid", "acid": {"flags": 1, "root_note": 60, "reserved1": 0, "reserved2": 0.0, "beats": 8, "meter_denominator": 4, "meter_numerator": 4, "tempo": 120.0}},
    {"type": "bext", "bext": {"description": "d", "originator": "o", "originator_reference": "r", "origination_date": "2020:01:02", "origination_time": "03:04:05", "time_reference": 1 << 33, "version": 2, "umid": bytes(range(64)), "coding_history": "A=PCM", "loudness_value": -23, "loudness_range": 5, "max_true_peak": -1, "max_momentary": 2, "max_short_term": 3}},
    {"type": "title", "text": "Titel"},
    {"type": "unknown", "id": b"abcd", "raw": b"xyz", "location": "info_list"},
    {"type": "label", "cue_point_id": 1, "text": "here"},
    {"type": "note", "cue_point_id": 1, "text": "a note"},
    {"type": "region", "cue_point_id": 1, "text": "", "region": {"cue_point_id": 1, "sample_length": 10, "purpose": b"rgn ", "country": 1, "language": 2, "dialect": 3, "code_page": 4}},
    {"type": "unknown", "id": b"zzzz", "raw": b"12", "location": "before_data"},
]


@pytest.mark.parametrize("container", ["riff", "rf64"])
def test_metadata_round_trip(container):
    got = {(m["type"], m.get("location")): m for m in parse(encode_wav(pack(RAMP, "s16"), "s16", 1, 8000, container, METADATA)).metadata}
    assert len(got) == len(METADATA)
    for m in METADATA:
        own = got[m["type"], m.get("location")]
        for name in ("text", "cue_point_id", "inst", "acid", "bext", "region", "id"):
            if name in m:
                assert own[name] == m[name] or name == "text" and own.get("text") == m["text"]
        for name in ("smpl", "cue"):
            if name in m:
                assert own[name] | m[name] == own[name]


def test_bad_metadata_is_dropped_or_raw():
    data = (b"data", pack(RAMP, "s16"), None)
    loops = struct.pack("<9I", 0, 0, 0, 0, 0, 0, 0, 5, 0)
    kinds = [m["type"] for m in parse(riff(FMT, (b"smpl", loops, None), (b"bext", bytes(100), None), (b"cue ", struct.pack("<I", 9), None), data)).metadata]
    assert "bext" not in kinds and "smpl" not in kinds and "cue" in kinds


def one_by_one(tag, block, channels):
    """The samples of a block, one code after another."""
    if tag == 2:
        if max(block[:channels]) > 6:
            return []
        rest = struct.unpack(f"<{3 * channels}h", block[channels : 7 * channels])
        delta, late, early = (list(rest[k * channels : (k + 1) * channels]) for k in range(3))
        out = [*early, *late]
        codes = [n for x in block[7 * channels :] for n in (x >> 4, x & 15)]
        for k, n in enumerate(codes):
            c = k % channels
            c1, c2 = codecs.MS_COEF[block[c]].tolist()
            new = max(-32768, min(32767, ((late[c] * c1 + early[c] * c2) >> 8) + (n - 16 if n > 7 else n) * delta[c]))
            early[c], late[c], delta[c] = late[c], new, max(16, int(codecs.MS_ADAPT[n]) * delta[c] >> 8)
            out.append(new)
        return out[: len(out) // channels * channels]
    tracks = []
    for c in range(channels):
        p, i = struct.unpack_from("<hB", block, 4 * c)
        if i > 88:
            return []
        track = [p]
        for at in range(4 * channels + 4 * c, len(block), 4 * channels):
            for n in (n for x in block[at : at + 4] for n in (x & 15, x >> 4)):
                step = int(codecs.IMA_STEPS[i])
                d = (step >> 3) + (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
                p = max(-32768, min(32767, p - d if n & 8 else p + d))
                i = max(0, min(88, i + int(codecs.IMA_INDEX[n])))
                track.append(p)
        tracks.append(track)
    return [x for frame in zip(*tracks, strict=False) for x in frame]


def test_adpcm_blocks():
    block = lambda tag, data, channels=1: codecs.decode_blocks(Audio(format_tag=tag, channels=channels, block_align=len(data)), [data])[0].ravel().tolist()
    assert block(17, struct.pack("<hBB", 100, 89, 0) + b"\x11") == []
    assert block(2, bytes([7]) + bytes(6)) == [] and block(2, b"") == []
    assert block(17, struct.pack("<hBB", 100, 0, 0) + b"\x07") == [100, 111, 113]
    assert block(2, struct.pack("<Bhhh", 0, 16, 10, 5) + b"\x1f") == [5, 10, 26, 10]
    stereo = block(17, struct.pack("<hBBhBB", 1, 0, 0, 2, 0, 0) + bytes(8), 2)
    assert len(stereo) == 2 * 9 and stereo[:2] == [1, 2]
    assert frames_per_block(Audio(format_tag=17, channels=1, block_align=36)) == 65
    rng = np.random.default_rng(8)
    for tag, channels in ((2, 1), (2, 2), (17, 1), (17, 2)):
        head = (7 if tag == 2 else 4) * channels
        blocks = []
        for _ in range(60):
            data = bytearray(rng.integers(0, 256, head + int(rng.choice([0, 1, 5, 8, 32, 32, 32])), dtype=np.uint8).tobytes())
            for c in range(channels):
                data[c if tag == 2 else 4 * c + 2] = int(rng.integers(0, 8 if tag == 2 else 91))
            blocks.append(bytes(data))
        got = codecs.decode_blocks(Audio(format_tag=tag, channels=channels, block_align=head + 32), blocks)
        assert [x.ravel().tolist() for x in got] == [one_by_one(tag, b, channels) for b in blocks]


def test_tables_over_files(spark, tmp_path):
    for k, container in enumerate(CONTAINERS):
        (tmp_path / f"{container}.wav").write_bytes(encode_wav(pack(RAMP * k, "s16"), "s16", 2, 8000, container, METADATA if container != "w64" else None))
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxx")
    files = read_files(spark, str(tmp_path), "*.wav")
    assert "content" not in files.select("path", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.total_pcm_frames) for r in audio_files(files).collect()}
    assert status["riff.wav"] == ("ok", 60) and status["broken.wav"][0] != "ok"
    assert audio_samples(files).count() == 360
    assert audio_frames(files, "f32", 50, 100).count() == 30
    assert {r.type for r in audio_metadata(files).collect()} == {m["type"] for m in METADATA}
    assert audio_metadata(files, types=["cue"]).count() == 2
    register(spark)
    files.createOrReplaceTempView("files")
    assert spark.sql("select c.* from files, lateral audio_chunks(content) c where c.id = X'64617461'").count() == 2
    assert spark.sql("select f.* from files, lateral audio_frames(content, 10, 5) f").count() == 15
    assert adpcm_frames(files).count() == 0


def test_source_reads_ranges_and_writes(spark, tmp_path):
    from echolith.sources.wav_source import WavDataSource

    spark.dataSource.register(WavDataSource)
    out = str(tmp_path / "out")
    rows = [(s, i, [i, -i]) for s in ("a", "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "stream string, frame_idx bigint, samples array<int>").repartition(2, "stream")
    df.write.format("wav").option("path", out).option("rate", 8000).mode("append").save()
    back = spark.read.format("wav").option("path", out).option("framesPerPartition", 300).load()
    assert back.count() == 2000 and back.rdd.getNumPartitions() == 8
    tail = back.where("frame_idx >= 900")
    assert tail.count() == 200 and tail.rdd.getNumPartitions() == 2
    assert tail.selectExpr("min(samples[0])", "min(samples[1])").first()[:] == (900, -999)
