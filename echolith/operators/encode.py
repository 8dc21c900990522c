"""PCM frames to container bytes: the only many-to-one operator, one BINARY row for each stream."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from echolith.functions.headers import ALAW, MAX_CHANNELS, MAX_RATE, MULAW
from echolith.sources.containers import ACID, FLOAT, INFO, INST, LOOP, LOUDNESS, PCM, POINT, SMPL, W64_RIFF, W64_TAIL

TYPES = {"u8": (PCM, 8), "s16": (PCM, 16), "s24": (PCM, 24), "s32": (PCM, 32), "f32": (FLOAT, 32), "f64": (FLOAT, 64), "alaw": (6, 8), "mulaw": (7, 8)}
CONTAINERS = ("riff", "w64", "rf64")
INFO_IDS = {v: k.encode() for k, v in INFO.items()}


#: Encodings that exist but cannot be written, and why.
REFUSED = {"extensible": "extensible formats", "ms_adpcm": "ADPCM", "ima_adpcm": "ADPCM"}


def checked_format(kind: str, channels: int, rate: int, container: str) -> None:
    """Raises ``ValueError`` for what cannot be written."""
    if kind in REFUSED:
        raise ValueError(f"{REFUSED[kind]} cannot be written; use one of {', '.join(TYPES)}")
    if kind not in TYPES:
        raise ValueError(f"unknown encoding {kind}; use one of {', '.join(TYPES)}")
    if container not in CONTAINERS:
        raise ValueError(f"{container} is not writable; use one of {', '.join(CONTAINERS)}")
    if not 0 < rate <= MAX_RATE or not 0 < channels <= MAX_CHANNELS:
        raise ValueError(f"{channels} channels at {rate} Hz are out of range")


def pack(samples: np.ndarray, kind: str, big: bool = False) -> bytes:
    """Interleaved samples as bytes."""
    if kind in ("u8", "alaw", "mulaw"):
        return np.asarray(samples).astype(np.uint8).tobytes()
    if kind == "s24":
        raw = np.asarray(samples).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
        return (raw[:, ::-1] if big else raw).tobytes()
    return np.asarray(samples).astype((">" if big else "<") + {"s": "i", "f": "f"}[kind[0]] + str(TYPES[kind][1] // 8)).tobytes()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _values(names: str, row: dict) -> list:
    return [row[n] for n in names.split()]


def metadata_bytes(rows: list[dict]) -> bytes:
    """Metadata rows as chunks: single ones first, then the INFO and adtl lists."""
    out, info, adtl = [], [], []
    for m in rows:
        kind = m["type"]
        if kind == "smpl":
            v, loops = m["smpl"], m["smpl"]["loops"]
            body = struct.pack("<7I", *_values(SMPL, v)) + struct.pack("<II", len(loops), len(v.get("data") or b""))
            out.append(_chunk(b"smpl", body + b"".join(struct.pack("<6I", *_values(LOOP, x)) for x in loops) + (v.get("data") or b"")))
        elif kind == "inst":
            out.append(_chunk(b"inst", struct.pack("<BbbBBBB", *_values(INST, m["inst"]))))
        elif kind == "cue":
            points = m["cue"]["points"]
            out.append(_chunk(b"cue ", struct.pack("<I", len(points)) + b"".join(struct.pack("<II4sIII", *_values(POINT, x)) for x in points)))
        elif kind == "acid":
            out.append(_chunk(b"acid", struct.pack("<IHHfIHHf", *_values(ACID, m["acid"]))))
        elif kind == "bext":
            v = {"umid": b"", "version": 0, "time_reference": 0} | m["bext"] | {"time_reference": int(m["bext"].get("time_reference") or 0)}
            text = b"".join((v.get(n) or "").encode()[:size].ljust(size, b"\0") for n, size in (("description", 256), ("originator", 32), ("originator_reference", 32), ("origination_date", 10), ("origination_time", 8)))
            head = struct.pack("<IIH", v["time_reference"] & 0xFFFFFFFF, v["time_reference"] >> 32, v["version"]) + (v["umid"] or b"")[:64].ljust(64, b"\0")
            out.append(_chunk(b"bext", text + head + struct.pack("<5h", *_values(LOUDNESS, v)) + bytes(180) + (v.get("coding_history") or "").encode()))
        elif kind in ("label", "note"):
            adtl.append(_chunk(b"labl" if kind == "label" else b"note", struct.pack("<I", int(m.get("cue_point_id") or 0)) + (m.get("text") or "").encode() + b"\0"))
        elif kind == "region":
            v = m["region"]
            fixed = struct.pack("<II4sHHHH", int(m.get("cue_point_id") or 0), *(v[n] for n in ("sample_length", "purpose", "country", "language", "dialect", "code_page")))
            adtl.append(_chunk(b"ltxt", fixed + (m["text"].encode() + b"\0" if m.get("text") else b"")))
        elif kind in INFO_IDS:
            info.append(_chunk(INFO_IDS[kind], (m.get("text") or "").encode() + b"\0"))
        elif kind != "unknown":
            raise ValueError(f"unknown metadata type {kind}")
        else:
            {"info_list": info, "adtl_list": adtl}.get(m.get("location"), out).append(_chunk(m["id"], m["raw"]))
    return b"".join([*out, *(_chunk(b"LIST", name + b"".join(x)) for name, x in ((b"INFO", info), (b"adtl", adtl)) if x)])


def assembled(form: bytes, size: int, align: int, container: str, more: bytes = b"") -> tuple[bytes, bytes]:
    """What stands before and behind ``size`` bytes of samples; ``form`` is the body of the format chunk."""
    if container == "w64":
        tail = bytes(size % 8)
        head = b"wave" + W64_TAIL + b"fmt " + W64_TAIL + struct.pack("<Q", 24 + len(form)) + form + bytes(len(form) % 8)
        whole = 16 + 8 + len(head) + 24 + size + len(tail)
        return W64_RIFF + struct.pack("<Q", whole) + head + b"data" + W64_TAIL + struct.pack("<Q", 24 + size), tail
    tail, fmt = bytes(size % 2), _chunk(b"fmt ", form)
    whole = 4 + len(fmt) + len(more) + 8 + size + len(tail)
    if container == "riff":
        return b"RIFF" + struct.pack("<I", min(whole, 0xFFFFFFFF)) + b"WAVE" + fmt + more + b"data" + struct.pack("<I", min(size, 0xFFFFFFFF)), tail
    long_sizes = struct.pack("<QQQI", whole + 36, size, size // align if align else 0, 0)
    return b"RF64" + b"\xff" * 4 + b"WAVE" + _chunk(b"ds64", long_sizes) + fmt + more + b"data" + b"\xff" * 4, tail


def wav_frame(size: int, kind: str, channels: int, rate: int, container: str = "riff", metadata: list[dict] | None = None) -> tuple[bytes, bytes]:
    """The bytes before and behind ``size`` bytes of samples. The first have the same length for every ``size``."""
    checked_format(kind, channels, rate, container)
    tag, bits = TYPES[kind]
    align = channels * bits // 8
    form = struct.pack("<HHIIHH", tag, channels, rate, rate * align & 0xFFFFFFFF, align, bits)
    return assembled(form, size, align, container, metadata_bytes(metadata or []))


def encode_wav(data: bytes, kind: str, channels: int, rate: int, container: str = "riff", metadata: list[dict] | None = None) -> bytes:
    """A whole file around the bytes of its samples. Wave64 takes no metadata."""
    head, tail = wav_frame(len(data), kind, channels, rate, container, metadata)
    return head + data + tail


def encode_streams(frames: DataFrame, kind: str, rate: int, container: str = "riff", key: str = "stream", order: str = "frame_idx", samples: str = "samples") -> DataFrame:
    """``key, content``: one container for each stream of ``frames`` (an array of one sample a channel in each row).

    Streams are the unit of work: each is sorted and packed in one task, after one shuffle by ``key``.
    """
    key_type = frames.schema[key].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        pcm = np.stack(group[samples].to_list()) if len(group) else np.zeros((0, 1))
        return pd.DataFrame({key: group[key].iloc[:1], "content": [encode_wav(pack(pcm.ravel(), kind), kind, pcm.shape[1], rate, container)]})

    return frames.select(key, order, samples).groupBy(key).applyInPandas(one, f"{key} {key_type}, content binary")


def with_metadata(content: bytes, rows: list[dict]) -> bytes:
    """A container written anew with metadata rows behind those that it has.

    RIFF and RF64 keep the format and the samples as they are, byte for byte; RIFX, AIFF and AIFC become RIFF.
    Wave64 holds no metadata here, and what cannot be read cannot be written: both raise ``ValueError``.
    """
    from echolith.sources.codecs import native
    from echolith.sources.containers import parse

    audio = parse(content)
    if audio.status != "ok" or audio.container == "w64":
        raise ValueError(f"no metadata can be joined: {audio.status if audio.status != 'ok' else 'Wave64'}")
    more = metadata_bytes([*audio.metadata, *rows])
    data = content[audio.data_pos : audio.data_pos + audio.data_size]
    if audio.container in ("riff", "rf64"):
        own = [c for c in audio.chunks if bytes(c["id"]) in (b"fmt ", b"fact")]
        form = next(content[c["offset"] : c["offset"] + c["size"]] for c in own if bytes(c["id"]) == b"fmt ")
        facts = b"".join(_chunk(b"fact", content[c["offset"] : c["offset"] + c["size"]]) for c in own if bytes(c["id"]) == b"fact")
        head, tail = assembled(form, len(data), audio.block_align, audio.container, facts + more)
        return head + data + tail
    if audio.tag in (ALAW, MULAW):
        kind = "alaw" if audio.tag == ALAW else "mulaw"
    else:
        kind, values = native(audio, data)
        if kind == "wide":
            raise ValueError(f"{audio.bits_per_sample} bits in {audio.container} cannot be written")
        data = pack(values, kind)
    head, tail = wav_frame(len(data), kind, audio.channels, audio.sample_rate, "riff", [*audio.metadata, *rows])
    return head + data + tail


def join_metadata(content: DataFrame, metadata: DataFrame, key: str = "stream") -> DataFrame:
    """Containers written anew with the metadata rows of their stream behind their own; see ``with_metadata``.

    ``metadata`` has ``type`` and any of the columns of ``audio_metadata``, of all types that it has.
    """
    import pyarrow as pa

    chosen, schema = content.select(key, "content"), content.select(key, "content").schema

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = [{k: v for k, v in r.items() if v is not None} for r in right.to_pylist()]
        out = [(r[key], with_metadata(r["content"], rows) if r["content"] is not None else None) for r in left.to_pylist()]
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], names=[key, "content"])

    return chosen.groupBy(key).cogroup(metadata.groupBy(key)).applyInArrow(one, schema)
