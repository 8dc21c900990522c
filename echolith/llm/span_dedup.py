"""Substring dedup by sliding sentence spans.

Sentences end at ``.``, ``!`` or ``?`` before white space, and at line ends; one of more than ``piece``
words counts as consecutive pieces of ``window`` words at most, cut behind words that the text itself
chooses: a passage is cut alike whatever stands before it, but for its first and last ``window`` words, so one
of over 50 words within a sentence always holds three whole pieces. A
span is a run of consecutive sentences, ``run`` of them at least and ``least_words`` words in all, and no
longer than it must be: one begins at each sentence and one ends at each, so that the spans inside a
repeated passage cover it to its last sentence, however short its sentences are. A span's key is a
128-bit hash of its sentences with their white space evened out.

A task takes about ``CHUNK`` spans at a time. Of spans with one key it keeps the first and settles the others at once, so a
passage that fills the corpus sends one entry a chunk. The entries are packed by ranges of their keys, and of those that
meet their like in a range the key's first place (by document id, then position) is found with map-side combining; a
join on the key, which the adaptive skew join may split, gives every span that is not the first of its kind. Sentences
that such a span covers are removed, with the white space behind them.

Null ids come last in order. Rows equal in id and text are one document: their spans are no repeats of
each other, and all of them get the same result. Null texts stay null and have no sentence; a text
without a repeated span is returned as it was. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import durable, packed, rows, table

#: Spans that a task sorts at once, and bytes of text whose spans make a range of keys.
CHUNK = 200_000
RANGE = 4 << 20
SENTENCE_END = re.compile(r"[.!?]\s+|\n\s*")
WORD_GAP = re.compile(r"\s+")


def cuts(words: list[str], window: int) -> list[int]:
    """The number of words before each cut: the word of least hash among any ``window`` in a row ends a piece."""
    ranks = list(map(crc32, " ".join(words).encode("utf-8", "surrogatepass").split(b" ")))
    found, at, least = [], -1, 0
    for new in range(window - 1, len(ranks)):
        if at <= new - window:
            part = ranks[new : new - window : -1] if new >= window else ranks[new::-1]
            least = min(part)
            at = new - part.index(least)
        elif ranks[new] < least:
            at, least = new, ranks[new]
        else:
            continue
        found.append(at + 1)
    return found


def sentences(text: str, piece: int = 16, window: int = 12) -> Iterator[tuple[int, int, list[str]]]:
    """(start, start of what follows, words) of each sentence or piece."""
    at = 0
    for m in chain(SENTENCE_END.finditer(text), (None,)):
        end, after = (m.start() + 1, m.end()) if m else (len(text), len(text))
        if words := text[at:end].split():
            if len(words) <= piece:
                yield at, after, words
            else:
                start, gaps = at, [g.end() for g in WORD_GAP.finditer(text, at + len(text[at:end]) - len(text[at:end].lstrip()), end)]
                for k, n in pairwise([0, *(c for c in cuts(words, window) if c < len(words)), len(words)]):
                    stop = gaps[n - 1] if n < len(words) else after
                    yield start, stop, words[k:n]
                    start = stop
            at = after


def spans(sizes: list[int], run: int = 2, least_words: int = 15) -> list[tuple[int, int]]:
    """(first sentence, number of sentences) of each span, from the sentences' words."""
    sums = [0, *accumulate(sizes)]
    found, j = set(), 0
    for i in range(len(sizes)):
        j = max(j, i + run)
        while j <= len(sizes) and sums[j] - sums[i] < least_words:
            j += 1
        if j > len(sizes):
            break
        found.add((i, j - i))
    i = len(sizes)
    for j in range(len(sizes), run - 1, -1):
        i = min(i, j - run)
        while i >= 0 and sums[j] - sums[i] < least_words:
            i -= 1
        if i < 0:
            break
        found.add((i, j - i))
    return sorted(found)


def span_keys(text: str | None, run: int = 2, least_words: int = 15) -> tuple[list[int], bytes]:
    """The place of each span, first sentence << 16 | number of sentences, and the 16 bytes of each key."""
    from xxhash import xxh3_128_digest

    if not text:
        return [], b""
    units = [w for _, _, w in sentences(text)]
    found = spans([len(w) for w in units], run, least_words)
    marks = b"".join(xxh3_128_digest(" ".join(w)) for w in units) if found else b""
    return [i << 16 | n for i, n in found], b"".join(xxh3_128_digest(marks[16 * i : 16 * (i + n)]) for i, n in found)


def chunk_rows(ids: list[tuple], owners: np.ndarray, places: np.ndarray, keys: np.ndarray, ranges: int) -> Iterator[tuple]:
    """Rows (range, run, document, places) of one chunk: packed entries, and the places settled here.

    ``ids`` has (id is null, id, document) for each owner; ``keys`` has two numbers a span.
    """
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=lambda k: ids[k] if not ids[k][0] else (True, 0, ids[k][2]))] = np.arange(len(ids))
    docs = np.array([x[2] for x in ids], np.int64)[owners]
    by = np.lexsort((places, order[owners], keys[:, 1], keys[:, 0]))
    docs, places, keys = docs[by], places[by], keys[by]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    firsts = np.flatnonzero(new)
    own = firsts[np.cumsum(new) - 1]
    later = np.flatnonzero((docs != docs[own]) | (places != places[own]))
    if len(later):
        later = later[np.argsort(docs[later], kind="stable")]
        cuts = np.flatnonzero(np.diff(docs[later])) + 1
        for part in np.split(later, cuts):
            yield -1 - int(docs[part[0]]) % ranges, None, int(docs[part[0]]), np.unique(places[part]).tolist()
    at = (keys[firsts, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    for part in np.split(firsts, np.flatnonzero(np.diff(at)) + 1):
        small = np.uint32 if int(places[part].max()) < 1 << 32 else np.uint64
        run = b"".join((np.uint32(len(part)).tobytes(), keys[part].T.tobytes(), docs[part].tobytes(), places[part].astype(small).tobytes()))
        yield int((int(keys[part[0], 0]) >> 32) * ranges >> 32), run, None, None


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the keys, documents and places of a packed run."""
    n = int.from_bytes(run[:4], "little")
    first, second, docs = (np.frombuffer(run, "<i8", n, 4 + 8 * n * k) for k in range(3))
    rest = run[4 + 24 * n :]
    return first, second, docs, np.frombuffer(rest, "<u4" if len(rest) == 4 * n else "<u8", n).astype(np.int64)


def repeated_entries(runs: list[bytes]) -> tuple[np.ndarray, ...]:
    """The entries of one range whose key another one has too."""
    parts = [np.concatenate(x) for x in zip(*map(unpacked, runs), strict=True)]
    by = np.lexsort((parts[1], parts[0]))
    k1, k2 = parts[0][by], parts[1][by]
    same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    by = by[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    return tuple(x[by] for x in parts)


def without(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the sentences of the spans at ``places``, the number of sentences, and of those removed."""
    if text is None:
        return None, 0, 0
    units = list(sentences(text))
    if not places:
        return text, len(units), 0
    gone = {k for p in places for k in range(p >> 16, (p >> 16) + (p & 0xFFFF))}
    kept = [text[: units[0][0]], *(text[s:e] for i, (s, e, _) in enumerate(units) if i not in gone)]
    return "".join(kept), len(units), len(gone)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, least_words: int = 15) -> DataFrame:
    """``id_col, text, n_sentences, n_removed`` for every row of ``docs``."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    base = base.withColumn("_doc", F.xxhash64("_id", "_text"))
    id_type = base.schema["_id"].dataType
    ranges = max(64, (base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // RANGE)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            ids, sizes, places, keys = [], [], [], []

            def close() -> Iterator[tuple]:
                if places:
                    yield from chunk_rows(ids, np.repeat(np.arange(len(ids)), sizes), np.array(places, np.int64), np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2), ranges)

            for i, d, t in rows(batches, "_id", "_doc", "_text"):
                at, found = span_keys(t, run, least_words)
                if at:
                    ids.append((i is None, i, d))
                    sizes.append(len(at))
                    places += at
                    keys.append(found)
                if len(places) >= CHUNK:
                    yield from close()
                    ids, sizes, places, keys = [], [], [], []
            yield from close()

        yield from packed(chunks(), pa.schema([("range", pa.int64()), ("run", pa.binary()), ("doc", pa.int64()), ("places", pa.list_(pa.int64()))]), 500)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(k1, k2, docs, at) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k1, k2, docs, at)], names=["k1", "k2", "doc", "at"])

        def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                found = repeated_entries(held)
                for k in range(0, len(found[0]), 20_000):
                    yield batch(*(x[k : k + 20_000] for x in found))

        held, own, settled, at = [], [], [], None
        for range_, run_, doc, places in rows(batches, "range", "run", "doc", "places"):
            if range_ != at:
                yield from close(held)
                held, at = [], range_
            if run_ is not None:
                held.append(run_)
            else:
                own += [doc] * len(places)
                settled += places
            if len(own) > 20_000:
                yield batch([None] * len(own), [None] * len(own), own, settled)
                own, settled = [], []
        yield from close(held)
        if own:
            yield batch([None] * len(own), [None] * len(own), own, settled)

    dealt = base.mapInArrow(sort, "range long, run binary, doc long, places array<long>")
    met = durable(dealt.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "k1 long, k2 long, doc long, at long").withColumnsRenamed({"doc": "_doc", "at": "_at"}))
    ids = base.groupBy("_doc").agg(F.first("_id").alias("_id"))
    found = met.where("k1 is not null").join(ids, "_doc")
    first = found.groupBy("k1", "k2").agg(F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_doc", "_at")).alias("_first"))
    later = found.join(first, ["k1", "k2"]).where((F.col("_doc") != F.col("_first._doc")) | (F.col("_at") != F.col("_first._at")))
    places = later.select("_doc", "_at").union(met.where("k1 is null").select("_doc", "_at")).groupBy("_doc").agg(F.collect_set("_at").alias("_places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("_id", to_arrow_type(id_type)), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])
        yield from packed(((i, *without(t, p)) for i, t, p in rows(batches, "_id", "_text", "_places")), schema, 500)

    joined = base.join(places.hint("shuffle_hash"), "_doc", "left").select("_id", "_text", "_places")
    return joined.mapInArrow(cut, f"_id {id_type.simpleString()}, text string, n_sentences long, n_removed long").withColumnRenamed("_id", id_col)


def op1_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))
