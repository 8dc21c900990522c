"""Suffix-array dedup: bytes that lie in a long string which also starts elsewhere.

The suffix array is sparse and complete for its purpose. In every window of ``length`` bytes one byte is
its anchor: the place of the smallest hash of ``GRAM`` bytes in it, the leftmost of equals. Equal windows
have their anchors at equal offsets, so two windows can only be equal if suffixes that start at anchors
share a prefix. The windows of an anchor are of two classes, by how far they reach to its left: up to ``HALF`` bytes, and
those have its next ``RIGHT`` bytes in common, or farther, and those have ``LEFT`` bytes before it and ``GRAM`` from it on in
common. A class takes part if those bytes occur twice at anchors; a task keeps one of the equal ones it has and settles the others at
once, so bytes that fill the corpus send one entry a chunk.

Distributed merge sort: every task sorts the suffixes it has (cut where the windows of their class end),
front-codes them into runs (length of the prefix shared with the suffix before, and the rest) and deals
the runs into ranges. A range's runs meet in one task, where a loser tree merges them; it keeps for each
candidate the prefix it shares with the last winner and compares from there on only, so no known prefix
is read again. In merged order, suffixes that share a prefix stand together with the shared length known,
and the bytes to the left of their anchors, which travel with them, tell how far a match extends to the
left: windows are equal if both sides together reach ``length``. Everything is compared byte by byte.

Copies: a task keeps one of its equal contexts and settles the others at once, so a passage that fills
the corpus sends one entry a run. Small groups are compared in pairs; larger ones window by window
through a table, in time linear in the group. The text of a document is shuffled once and used twice.

Nulls and empty texts have no byte. Repeated rows are documents of their own, so all their windows
repeat. Texts shorter than ``length`` keep all bytes. Bytes are judged on the input, so overlapping and
adjacent strings are all removed. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import durable, packed, rows, table

LENGTH = 200
GRAM = 32
#: Windows that reach ``HALF`` bytes or fewer to the left of their anchor have ``RIGHT`` bytes from it on in common, the
#: others ``LEFT`` before it and ``GRAM`` from it on.
HALF, RIGHT, LEFT = 100, 96, 96
#: Bytes hashed at once, anchors sorted at once, and suffixes in a run: what a task holds does not grow with the data.
CHUNK = 1 << 18
ANCHORS = 200_000
RUN = 40_000
#: Bytes of text whose anchors make a range.
RANGE = 8 << 20
PAIRS = 24
BASE = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray) -> dict[int, np.ndarray]:
    """Polynomials of the 1, 2, 4, ... 128 bytes at each place, modulo 2^64."""
    found, width, factor = {1: data.astype(np.uint64) + np.uint64(1)}, 1, BASE
    while width < 128 and len(data) >= 2 * width:
        low = found[width]
        found[2 * width] = low[:-width] * np.uint64(factor) + low[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place."""
    return mixed(rolling(data)[GRAM])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of the windows inside the pieces [starts, ends), by class: hash of what the class has in common, place of the
    anchor, class, most and fewest bytes that its windows have to the left, and piece."""
    sums, n = rolling(data), len(data) - length + 1
    hashes = mixed(sums[GRAM])
    low = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    width, wanted = 1, length - GRAM + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wanted:
        low = np.minimum(low[: n], low[wanted - width :][:n])
    low = (low[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(starts)), np.maximum(ends - starts, 0))[:n]
    inside = np.arange(n) + length <= ends[piece]
    window = np.flatnonzero(inside)
    if not len(window):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 5)
    place = low[window]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (piece[window[1:]] != piece[window[:-1]]))))
    last = np.append(new[1:], len(window)) - 1
    at, most, least, own = place[new], place[new] - window[new], place[new] - window[last], piece[window[new]]
    near, far = least <= HALF, most > HALF
    right = sums[64][at[near]] * np.uint64(pow(BASE, RIGHT - 64, 1 << 64)) + sums[RIGHT - 64][at[near] + 64]
    left = sums[LEFT + GRAM][at[far] - LEFT]
    join = lambda x, y: np.concatenate((x[near], y[far]))
    kind = np.repeat([0, 1], [near.sum(), far.sum()])
    return mixed(np.concatenate((right, left)) + kind.astype(np.uint64)), join(at, at), kind, join(np.minimum(most, HALF), most), join(least, np.maximum(least, HALF + 1)), join(own, own)


def pieces(found: Iterator[tuple[object, bytes]], length: int = LENGTH) -> Iterator[list[tuple[object, int, bytes]]]:
    """Chunks of (key, offset, bytes); a long text comes in pieces that overlap by less than a window."""
    held, size = [], 0
    for key, data in found:
        for at in range(0, max(1, len(data) - length + 1), 8 * CHUNK):
            part = data[at : at + 8 * CHUNK + length - 1]
            if len(part) >= length:
                held.append((key, at, part))
                size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchor_rows(found: Iterator[tuple[object, bytes]], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays of hash, key and packed place: byte << 17 | class << 16 | most bytes to its left << 8 | fewest."""
    for held in pieces(found, length):
        sizes = np.array([len(x[2]) for x in held])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        h, at, kind, most, least, piece = anchors(data, starts, starts + sizes, length)
        keys, shift = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64) - starts
        yield h, keys[piece], (at + shift[piece]) << 17 | kind << 16 | most << 8 | least


def chunk_rows(hashes: np.ndarray, keys: np.ndarray, places: np.ndarray, ranges: int) -> Iterator[tuple]:
    """Rows (range, entries, key, places) of one chunk: hashes that occur once in it with their places, those that occur
    more often alone, and the places of the latter, which are settled here."""
    by = np.argsort(hashes, kind="stable")
    hashes, keys, places = hashes[by], keys[by], places[by]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    firsts = np.flatnonzero(new)
    many = np.diff(np.append(firsts, len(hashes))) > 1
    settled = np.flatnonzero(np.repeat(many, np.diff(np.append(firsts, len(hashes)))))
    if len(settled):
        settled = settled[np.argsort(keys[settled], kind="stable")]
        for part in np.split(settled, np.flatnonzero(np.diff(keys[settled])) + 1):
            yield -1 - int(keys[part[0]]) % ranges, None, int(keys[part[0]]), places[part].tolist()
    at = (hashes[firsts] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    for part in np.split(np.arange(len(firsts)), np.flatnonzero(np.diff(at)) + 1):
        once, often = firsts[part[~many[part]]], firsts[part[many[part]]]
        run = b"".join((np.uint32(len(once)).tobytes(), hashes[once].tobytes(), keys[once].tobytes(), places[once].tobytes(), hashes[often].tobytes()))
        yield int(at[part[0]]), run, None, None


def met_entries(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the entries of one range whose hash another chunk has too."""
    counts = [int.from_bytes(x[:4], "little") for x in found]
    once = np.concatenate([np.frombuffer(x, "<u8", n, 4) for x, n in zip(found, counts, strict=True)])
    often = np.unique(np.concatenate([np.frombuffer(x[4 + 24 * n :], "<u8") for x, n in zip(found, counts, strict=True)]))
    _, which, n = np.unique(once, return_inverse=True, return_counts=True)
    wanted = n[which] > 1
    if len(often):
        wanted |= often[np.minimum(np.searchsorted(often, once), len(often) - 1)] == once
    keys, places = (np.concatenate([np.frombuffer(x, "<i8", n, 4 + 8 * n * k) for x, n in zip(found, counts, strict=True)]) for k in (1, 2))
    return keys[wanted], places[wanted]


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many leading bytes are equal, when the first ``at`` are known to be."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    at = min(at, n)
    while at < n and a[at] == b[at]:
        at += 1
    return at


def shared_left(a: bytes, b: bytes) -> int:
    n, k = min(len(a), len(b)), 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    return k


def runs(found: list[tuple[bytes, bytes, int, int]], ranges: int) -> Iterator[tuple]:
    """Rows (range, run, key, start, end) of one sorted, front-coded run, and of copies settled here.

    ``found`` has suffix (the hash of its group first), left bytes, key and packed place.
    """
    found.sort()
    blocks: dict[int, list] = {}
    copies: dict[int, list[tuple[int, int]]] = {}
    k = 0
    while k < len(found):
        suffix, left, key, at = found[k]
        n = k + 1
        while n < len(found) and found[n][0] == suffix and found[n][1] == left:
            n += 1
        settled = n - k > 1
        if settled:
            for _, _, own, place in found[k:n]:
                byte = place >> 17
                copies.setdefault(own, []).append((byte - len(left), byte + len(suffix) - 8))
        blocks.setdefault(int.from_bytes(suffix[:8]) * ranges >> 64, []).append((suffix, left, settled, key, at))
        k = n
    for own, spans in copies.items():
        for start, end in merged_spans(spans):
            yield -1 - own % ranges, None, own, start, end
    for range_, entries in blocks.items():
        before, lcps, rests, lefts = b"", [], [], []
        for suffix, left, *_ in entries:
            lcp = shared(before, suffix, 0)
            lcps.append(lcp)
            rests.append(suffix[lcp:])
            lefts.append(left)
            before = suffix
        sizes = [len(x) for x in rests], [len(x) for x in lefts]
        refs = [e[2] for e in entries], [e[3] for e in entries], [e[4] for e in entries]
        yield range_, zlib.compress(pickle.dumps((lcps, sizes, refs, b"".join(rests), b"".join(lefts))), 1), None, None, None


def unpacked(run: bytes) -> Iterator[tuple[int, bytes, bytes, bool, int, int]]:
    """Entries of a run, each with the length of the prefix it shares with the one before."""
    lcps, (rest_sizes, left_sizes), refs, rests, lefts = pickle.loads(zlib.decompress(run))
    suffix, r, s = b"", 0, 0
    for lcp, rn, sn, *ref in zip(lcps, rest_sizes, left_sizes, *refs, strict=True):
        suffix = suffix[:lcp] + rests[r : r + rn]
        yield lcp, suffix, lefts[s : s + sn], *ref
        r, s = r + rn, s + sn


class LoserTree:
    """Merges sorted runs; every entry comes with the length of the prefix it shares with the one before."""

    def __init__(self, found: list[Iterator[tuple]]):
        self.runs, self.n = found, len(found)
        self.heads: list[tuple | None] = [next(r, None) for r in found]
        self.lcp = [0] * self.n
        self.losers = [-1] * self.n
        for i in range(self.n):
            self._enter(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser keeps the prefix that it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        p, q = self.lcp[a], self.lcp[b]
        if p != q:
            return p > q
        h = shared(x[1], y[1], p)
        if x[1][h : h + 1] <= y[1][h : h + 1]:
            self.lcp[b] = h
            return True
        self.lcp[a] = h
        return False

    def _enter(self, i: int) -> None:
        node = (i + self.n) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        if not self.n:
            return
        while (head := self.heads[i := self.losers[0]]) is not None:
            yield (self.lcp[i], *head[1:])
            self.heads[i] = after = next(self.runs[i], None)
            self.lcp[i] = after[0] if after else 0
            node = (i + self.n) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.losers[0] = i


def repeated(group: list[tuple], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the strings of a group, in merged order, that occur in another of its members."""
    same: dict[tuple[bytes, bytes], list[tuple]] = {}
    order, lcps, least = [], [], 0
    for lcp, suffix, left, settled, key, at in group:
        least = lcp if not lcps else min(least, lcp)
        if (own := same.get((suffix, left))) is None:
            own = same[suffix, left] = []
            order.append((suffix, left))
            lcps.append(least)
            least = 1 << 30
        own.append((settled, key, at))
    whole = [len(same[c]) > 1 or same[c][0][0] for c in order]
    for c, w in zip(order, whole, strict=True):
        if w:
            for settled, key, at in same[c]:
                if not settled:
                    yield key, (at >> 17) - len(c[1]), (at >> 17) + len(c[0]) - 8
    if len(order) == 1 or all(whole):
        return
    marks: dict[int, set[int]] = {}
    if len(order) <= PAIRS:
        for i in range(len(order)):
            right = 1 << 30
            for j in range(i + 1, len(order)):
                right = min(right, lcps[j])
                reach = right - 8
                if not (whole[i] and whole[j]):
                    span = range(length - reach, shared_left(order[i][1], order[j][1]) + 1)
                    if len(span):
                        marks.setdefault(i, set()).update(span)
                        marks.setdefault(j, set()).update(span)
    else:
        context = [left + suffix[8:] for suffix, left in order]
        by_left: dict[int, list[int]] = {}
        for i, (suffix, left) in enumerate(order):
            for n in range(length - len(suffix) + 8, len(left) + 1):
                by_left.setdefault(n, []).append(i)
        for n, members in by_left.items():
            first: dict[bytes, int] = {}
            for i in members:
                at = len(order[i][1]) - n
                if (j := first.setdefault(context[i][at : at + length], i)) != i:
                    marks.setdefault(i, set()).add(n)
                    marks.setdefault(j, set()).add(n)
    for i, lefts in marks.items():
        if not whole[i]:
            _, key, at = same[order[i]][0]
            for n in lefts:
                yield key, (at >> 17) - n, (at >> 17) - n + length


def merged_spans(found: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _settle(part: pd.DataFrame) -> pd.DataFrame:
    """One range: merges its runs and gives the repeated strings; rows settled before pass through."""
    merged = part["run"].notna()
    found: list[tuple[int, int, int]] = []
    group: list[tuple] = []

    def close() -> None:
        if group and (len(group) > 1):
            by_key: dict[int, list] = {}
            for key, start, end in repeated(group):
                by_key.setdefault(key, []).append((start, end))
            found.extend((key, *span) for key, spans in by_key.items() for span in merged_spans(spans))

    for entry in LoserTree([unpacked(r) for r in part.loc[merged, "run"]]):
        if entry[0] < 8 + GRAM:
            close()
            group = []
        group.append(entry)
    close()
    new = pd.DataFrame(found, columns=["key", "start", "end"], dtype="int64")
    return pd.concat([part.loc[~merged, ["key", "start", "end"]].astype("int64"), new], ignore_index=True)


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``_key, _spans`` for the rows of ``keyed`` (``_key, _id, _data``) that hold a repeated string."""

    dealt = max(64, (keyed.agg(F.sum(F.octet_length("_data"))).first()[0] or 0) // RANGE)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            held, size = [], 0
            for parts in anchor_rows(rows(batches, "_key", "_data")):
                held.append(parts)
                size += len(parts[0])
                if size >= ANCHORS:
                    yield from chunk_rows(*map(np.concatenate, zip(*held, strict=True)), dealt)
                    held, size = [], 0
            if size:
                yield from chunk_rows(*map(np.concatenate, zip(*held, strict=True)), dealt)

        yield from packed(chunks(), pa.schema([("range", pa.int64()), ("run", pa.binary()), ("key", pa.int64()), ("places", pa.list_(pa.int64()))]), 500)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(keys, places) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int64())], names=["key", "at"])

        def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            keys, places = met_entries(held) if len(held) > 1 else ((), ())
            for k in range(0, len(keys), 20_000):
                yield batch(keys[k : k + 20_000], places[k : k + 20_000])

        held, keys, settled, at = [], [], [], None
        for range_, run, key, places in rows(batches, "range", "run", "key", "places"):
            if range_ != at:
                yield from close(held)
                held, at = [], range_
            if run is not None:
                held.append(run)
            else:
                keys += [key] * len(places)
                settled += places
            if len(keys) > 20_000:
                yield batch(keys, settled)
                keys, settled = [], []
        yield from close(held)
        yield batch(keys, settled)

    marked = keyed.select("_key", "_data").mapInArrow(mark, "range long, run binary, key long, places array<long>")
    met = marked.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "key long, at long")
    wanted = durable(met.groupBy(F.col("key").alias("_key")).agg(F.collect_set("at").alias("_at")))
    ranges = max(64, (wanted.agg(F.sum(F.size("_at"))).first()[0] or 0) // 4000)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int64()), ("run", pa.binary()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

        def out() -> Iterator[tuple]:
            held: list[tuple] = []
            for key, _, data, places in rows(batches, "_key", "_id", "_data", "_at"):
                for at in places:
                    byte, kind, most, least = at >> 17, at >> 16 & 1, at >> 8 & 255, at & 255
                    common = b"b" + data[byte - LEFT : byte + GRAM] if kind else b"a" + data[byte : byte + RIGHT]
                    group = hashlib.blake2b(common, digest_size=8).digest()
                    held.append((group + data[byte : byte + LENGTH - least], data[byte - most : byte], key, at))
                    if len(held) >= RUN:
                        yield from runs(held, ranges)
                        held = []
            yield from runs(held, ranges)

        yield from packed(out(), schema, 500)

    sorted_ = keyed.join(wanted.hint("shuffle_hash"), "_key").select("_key", "_id", "_data", "_at").mapInArrow(sort, "range long, run binary, key long, start long, end long")
    spans = sorted_.groupBy("range").applyInPandas(_settle, "key long, start long, end long")
    return spans.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<start,end>>, kept binary, n_bytes`` for every row of ``docs``."""
    base = docs.select(F.xxhash64(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_data"))
    id_type = base.schema["_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("_id", to_arrow_type(id_type)), ("spans", pa.list_(span)), ("kept", pa.binary()), ("n_bytes", pa.int64())])

        def out() -> Iterator[tuple]:
            for i, _, data, spans in rows(batches, "_id", "_key", "_data", "_spans"):
                gone = merged_spans((s["start"], s["end"]) for s in spans or ())
                at, kept = 0, []
                for start, end in gone:
                    kept.append(data[at:start])
                    at = end
                yield i, [{"start": s, "end": e} for s, e in gone], b"".join(kept) + data[at:], len(data)

        yield from packed(out(), schema, 200)

    joined = base.join(repeated_spans(base).hint("shuffle_hash"), "_key", "left").select("_key", "_id", "_data", "_spans")
    return joined.mapInArrow(cut, f"_id {id_type.simpleString()}, spans array<struct<start:long,end:long>>, kept binary, n_bytes long").withColumnRenamed("_id", id_col)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
