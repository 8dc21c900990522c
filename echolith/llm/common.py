"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the space and the ASCII controls from tab to return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for durable tables, which all machines share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine (tests) gets a folder of its own and any other one fails.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="echolith-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage into files that every executor can read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back. Small row groups keep what a writing task holds small."""
    path = path or new_path(df.sparkSession)
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"


def remove(spark: SparkSession, path: str) -> None:
    """A table of the shared folder that nothing reads any more goes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Bits of a map of ids, and of one row of it (fixed by the functions that make it).
MARKS, ROW = 1 << 25, 1 << 15


def mark(value: Column, size: int = MARKS) -> Column:
    """The bit that stands for a value."""
    return F.pmod(F.xxhash64(value), F.lit(size))


def bit_map(marks: DataFrame, at: str) -> DataFrame:
    """``_row, _bits``: the bits ``at`` that a table has, in rows of 4 KiB."""
    return marks.groupBy(F.floor(F.col(at) / ROW).alias("_row")).agg(F.bitmap_construct_agg(F.pmod(F.col(at), F.lit(ROW))).alias("_bits"))


def with_likely(rows: DataFrame, ids: DataFrame, on: str = "_id") -> DataFrame:
    """``rows`` with ``_likely``: true for all ids of a table, and for few other ones while the map is not full.

    The map has ``MARKS / ROW`` rows of 4 KiB at most, whatever the table, so it is broadcast.
    """
    bits = bit_map(ids.select(mark(F.col(on)).alias("_mark")), "_mark")
    at = F.pmod(mark(F.col(on)), F.lit(ROW))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    met = rows.withColumn("_bits_row", F.floor(mark(F.col(on)) / ROW)).join(F.broadcast(bits.withColumnRenamed("_row", "_bits_row")), "_bits_row", "left")
    likely = F.col(on).isNotNull() & (F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")), F.lit(0)) == 1)
    return met.withColumn("_likely", likely).drop("_bits_row", "_bits")


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples, a slice of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def packed(items: Iterable[tuple], schema: pa.Schema, size: int = 2000, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows, and of little more than ``most`` bytes and characters."""
    held: list[tuple] = []
    weight = 0
    for item in items:
        held.append(item)
        for x in item:
            if isinstance(x, (bytes, str)):
                weight += len(x)
        if len(held) >= size or weight >= most:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
