"""Rows of a content column, made by Python functions in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def from_content(df: DataFrame, key: str, columns: str, make: Callable[..., Iterable[tuple]], inputs: tuple[str, ...] = ("content",), size: int = 4096) -> DataFrame:
    """``key`` and ``columns`` (a DDL string) for every tuple that ``make`` yields from ``inputs``.

    One row of ``df`` is in memory at a time beside its batch; nothing is shuffled. A null content makes no row.
    """
    chosen = df.select(key, *inputs)
    declared = _parse_datatype_string(columns)
    schema = StructType([chosen.schema[key], *declared.fields])

    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def rows() -> Iterator[tuple]:
            for batch in found:
                names = batch.schema.names
                for k in range(batch.num_rows):
                    own = {n: batch.column(n)[k].as_py() for n in names}
                    if all(own[n] is not None for n in inputs[:1]):
                        for row in make(*(own[n] for n in inputs)):
                            yield own[key], *row

        yield from batches(rows(), to_arrow_schema(schema), size)

    return chosen.mapInArrow(work, schema)


def pcm_batches(found: Iterable[tuple], schema: pa.Schema, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Batches ``key, frame_idx, samples`` from (key, first frame, array of frames by channels), made of whole arrays."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        counts = np.array([len(pcm) for *_, pcm in held])
        keys = pa.array([k for k, *_ in held], schema.field(0).type).take(pa.array(np.repeat(np.arange(len(held)), counts)))
        places = np.concatenate([np.arange(first, first + len(pcm)) for _, first, pcm in held])
        ends = np.cumsum(np.repeat([pcm.shape[1] for *_, pcm in held], counts))
        values = pa.array(np.concatenate([pcm.ravel() for *_, pcm in held]), schema.field(2).type.value_type)
        samples = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)
        return pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int64()), samples.cast(schema.field(2).type)], schema=schema)

    n = 0
    for key, first, pcm in found:
        for at in range(0, len(pcm), size):
            part = pcm[at : at + size]
            held.append((key, first + at, part))
            n += len(part)
            if n >= size:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def pcm_from(df: DataFrame, key: str, value: str, inputs: tuple[str, ...], make: Callable[[list[dict]], Iterable[tuple]], rows: int = 1) -> DataFrame:
    """``key, frame_idx, samples`` from ``make``, which takes ``rows`` rows at a time as dicts and gives what ``pcm_batches`` takes."""
    chosen = df.select(key, *inputs)
    schema = StructType([chosen.schema[key], *_parse_datatype_string(f"frame_idx bigint, samples array<{value}>").fields])

    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def each() -> Iterator[tuple]:
            for batch in found:
                for k in range(0, batch.num_rows, rows):
                    own = [r for r in batch.slice(k, rows).to_pylist() if r[inputs[0]] is not None]
                    yield from make(own)

        yield from pcm_batches(each(), to_arrow_schema(schema))

    return chosen.mapInArrow(work, schema)
