"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprint: the 64-bit majority of the XXH64 hashes (seed 42) of a text's word shingles, repeats
included. Two fingerprints link at ``distance`` or fewer differing bits.

Index: the 64 bits are cut into ``segments``; whenever two fingerprints link, some ``together``
segments taken jointly differ by at most one bit. Every distinct fingerprint is entered once for each
such choice of segments and each bit of it, with that bit deleted; an equality join on those variants
meets every linking pair, and the join's own condition verifies the distance. A pair shares many
variants, so only the first choice of segments that fits it lets it through: each link leaves the join
once. Copies never enter the index: it holds distinct fingerprints. With 3 segments an entry has 64
variants of 20 to 21 bits, with 3 of 6 taken together 640 of 31 bits; the number of distinct fingerprints chooses
(``MOST_OF_THREE``). Both give the same links.

Null texts count as empty. A text without words has fingerprint zero, which links like any other.
Repeated rows share their fingerprint and component. A null id takes part in links but is never a
component's id. Fewer words than a shingle has make one shingle of them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolith.llm.common import durable, packed, rows, table
from echolith.llm.components import components

SEED = 42
#: Distinct fingerprints up to which three segments are the cheaper cut: some 50 share a variant by chance there.
MOST_OF_THREE = 50_000_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned fingerprint of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # of bytes: lowers A-Z, splits at the ASCII white space
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= width:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 14):
        part = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``_id, _fp`` (the fingerprint as a signed long) for every row; one pass, no shuffle."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = base.schema["_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("_id", to_arrow_type(id_type)), ("_fp", pa.int64())])
        yield from packed(((i, _signed(fingerprint(t, width))) for i, t in rows(batches, "_id", "_text")), schema)

    return base.mapInArrow(work, f"_id {id_type.simpleString()}, _fp long")


def choices(segments: int, together: int, distance: int) -> list[int]:
    """The bit masks of ``together`` segments, once it is sure that one of them differs by at most a bit."""
    if max(sum(sorted(x)[:together]) for x in _spreads(distance, segments)) > 1:
        raise ValueError(f"{together} of {segments} segments may differ by more than a bit at distance {distance}")
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in c) for c in combinations(range(segments), together)]


def _spreads(total: int, bins: int) -> list[tuple[int, ...]]:
    if bins == 1:
        return [(total,)]
    return [(i, *rest) for i in range(total + 1) for rest in _spreads(total - i, bins - 1)]


def links(nodes: DataFrame, fp: str = "_fp", distance: int = 4, segments: int = 3, together: int = 1) -> DataFrame:
    """``a, b`` with a < b: each pair of distinct fingerprints at ``distance`` or fewer bits, once."""
    masks = choices(segments, together, distance)
    variants = F.array(*(F.struct(F.lit(64 * k + bit).cast("short").alias("tag"), F.col(fp).bitwiseAND(F.lit(_signed(mask & ~(1 << bit)))).alias("key")) for k, mask in enumerate(masks) for bit in range(64) if mask >> bit & 1))
    index = nodes.select(F.col(fp).alias("fp"), F.inline(variants))
    a, b = index.alias("a"), index.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first, alone = F.lit(len(masks) - 1), F.lit(False)
    for k in reversed(range(len(masks))):
        within = x.bitwiseAND(F.lit(_signed(masks[k])))
        if k < len(masks) - 1:
            first = F.when(F.bit_count(within) <= 1, F.lit(k)).otherwise(first)
        lowest = (masks[k] & -masks[k]).bit_length() - 1
        alone = alone | ((F.col("a.tag") == 64 * k + lowest) | ((F.col("a.tag") >= 64 * k) & (F.col("a.tag") < 64 * k + 64) & (within != 0)))
    meets = (F.col("a.tag") == F.col("b.tag")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, meets & (F.bit_count(x) <= distance) & (F.shiftright(F.col("a.tag").cast("int"), 6) == first) & alone).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def rooted(prints: DataFrame, distance: int, segments: int | None, together: int) -> DataFrame:
    """``_fp, _root`` for every distinct fingerprint; the root stands for its component."""
    nodes = durable(prints.select("_fp").distinct())
    if segments is None:
        segments, together = (3, 1) if distance < 6 and nodes.count() <= MOST_OF_THREE else (6, 3)
    roots = components(links(nodes, "_fp", distance, segments, together), "a", "b")
    return durable(nodes.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("_root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, segments: int | None = None, together: int = 1) -> DataFrame:
    """``id_col, fp long, component_id`` for every row; the component's id is its smallest id."""
    prints = durable(fingerprints(docs, id_col, text_col, width))
    least = prints.groupBy("_fp").agg(F.min("_id").alias("_least"))
    known = least.join(rooted(prints, distance, segments, together), "_fp")
    classes = known.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = known.join(classes, "_root").select("_fp", "component_id")
    return prints.join(named, "_fp", "left").select(F.col("_id").alias(id_col), F.col("_fp").alias("fp"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, segments: int | None = None, together: int = 1) -> DataFrame:
    """One row of each group of near-duplicates, all columns: the one of smallest id (nulls last), then hash of the text."""
    with_hash = docs.select(F.struct(id_col, F.xxhash64(text_col).alias("t")).alias("_key"), F.col(text_col).alias("_text"))
    prints = durable(fingerprints(with_hash, "_key", "_text", width))
    place = F.struct(F.col(f"_id.{id_col}").isNull().alias("no_id"), F.col(f"_id.{id_col}").alias("id"), F.col("_id.t").alias("t"))
    least = prints.groupBy("_fp").agg(F.min(place).alias("_least"))
    kept = least.join(rooted(prints, distance, segments, together), "_fp").groupBy("_root").agg(F.min("_least").alias("_least")).select(F.col("_least.id").alias("_id"), F.col("_least.t").alias("_t"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_hash"))
    met = whole.join(kept.hint("shuffle_hash"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t")), "left_semi")
    # Rows that repeat an id and its text are the same document.
    first = F.row_number().over(Window.partitionBy("_own", "_hash").orderBy(F.xxhash64("_row")))
    return met.withColumn("_n", first).where("_n = 1").select("_row.*")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
