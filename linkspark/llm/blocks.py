"""Packed blocks of rows, and keyed exchanges of numbers between blocks and buckets.

Operators that look at every word of a corpus would shuffle a row a word. Instead a map task packs some MB of texts
into one compressed block; what a block has to say about a key goes to the key's bucket as one packed row, and the
bucket answers the block with one packed row. Blocks have a size, and buckets are as many as the input's bytes ask for,
so what a task holds doesn't grow with the corpus, but for the few bytes that each block sends about a hot key. A block
sends a row to a bucket only if it has keys there: rows are at most as many as a plain shuffle by key would have.

A block is made from consecutive rows of an input partition, so its content is fixed as long as the input is a table
scan; pass tables, not the output of an unordered shuffle (materialize() makes one).
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.storage import partitions, small_batches

#: Bytes of column data in a block; a longer row is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of input files, which are compressed, to a bucket.
BUCKET_BYTES = 4 << 20
BLOCK_SCHEMA = "block long, data binary"
_LEVEL = 1


def squeeze(data: bytes | memoryview) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress where the high bytes agree."""
    size = values.dtype.itemsize
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes()) if len(values) else b""


def unpack_numbers(data: bytes, dtype: np.dtype | type) -> np.ndarray:
    if not data:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(expand(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 by differences."""
    return pack_numbers(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, np.uint64), dtype=np.uint64)


def pack_rows(df: DataFrame, block_bytes: int = BLOCK_BYTES, width: int | None = None) -> DataFrame:
    """(block, data): the rows of ``df`` in compressed blocks, dealt evenly by block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base, number = (task.partitionId() if task else 0) << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([squeeze(sink.getvalue())], pa.binary())], ["block", "data"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = _rows_within(batch, at, block_bytes - size, bool(held))
                if take:
                    held.append(batch.slice(at, take))
                    size += _data_bytes(batch, at, take)
                    at += take
                if size >= block_bytes or not take:
                    yield flush()
                    number += 1
                    held, size = [], 0
        if held:
            yield flush()

    small_batches(df.sparkSession)
    return df.mapInArrow(pack, BLOCK_SCHEMA).repartition(width or partitions(df.sparkSession), "block")


def _row_ends(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """Running bytes of the rows from ``at`` on: 8 each, and the length of strings and binaries."""
    total = np.full(batch.num_rows - at, 8, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            total += np.asarray(pc.binary_length(col.slice(at)).fill_null(0)).astype(np.int64)
    return np.cumsum(total)


def _rows_within(batch: pa.RecordBatch, at: int, room: int, some: bool) -> int:
    """How many rows from ``at`` on fit; one at least if the block is still empty."""
    fit = int(np.searchsorted(_row_ends(batch, at), room, "right"))
    return fit if some else max(1, fit)


def _data_bytes(batch: pa.RecordBatch, at: int, take: int) -> int:
    return int(_row_ends(batch, at)[take - 1])


def slices(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes; a longer row is a part of its own."""
    at = 0
    while at < batch.num_rows:
        take = _rows_within(batch, at, most, False)
        yield batch.slice(at, take)
        at += take


def unpack_rows(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(expand(data)) as stream:
        return stream.read_all()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables below ``df``, as the optimizer knows them without reading any; where it doesn't
    know, the bytes of the rows, counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    if all(x < 1 << 60 for x in known):
        return sum(known)
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return df.select(sum(sizes, F.lit(8 * len(df.columns))).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0


def buckets(df: DataFrame) -> int:
    """A power of two: a bucket for every BUCKET_BYTES of the input, and some for each reducer."""
    least = max(2 * partitions(df.sparkSession), -(-input_bytes(df) // BUCKET_BYTES))
    return 1 << (least - 1).bit_length()


def runs(bucket: np.ndarray) -> dict[int, slice]:
    """Where each bucket lies in an ascending array of buckets; only those that occur."""
    some, first = np.unique(bucket, return_index=True)
    ends = np.append(first, len(bucket))[1:].tolist()
    return {k: slice(a, b) for k, a, b in zip(some.tolist(), first.tolist(), ends, strict=True)}


@contextmanager
def _uncollected() -> Iterator[None]:
    """Millions of strings and lists at once hold no cycles; looking for some takes longer than the work itself."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def each_block(blocks: DataFrame, fn, schema: str) -> DataFrame:
    """fn(block, table) -> record batches, for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with _uncollected():
                    made = list(fn(block, unpack_rows(data.as_py())))
                yield from made

    return blocks.mapInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn(table, {bucket: answer}) -> table, for every block and what the buckets answered (block, bucket, answer)."""
    nothing = _no_rows(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist(), strict=True))
        with _uncollected():
            made = [fn(unpack_rows(data.as_py()), told) for data in left.column("data")]
        return pa.concat_tables(made) if made else nothing

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def of_asked(blocks: DataFrame, asked: DataFrame, fn, schema: str) -> DataFrame:
    """fn(rows of the block, what was asked of it) -> table, for every block that ``asked`` (block, ...) names."""
    nothing = _no_rows(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right) if right.num_rows else nothing

    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema)


def _no_rows(ddl: str) -> pa.Table:
    """Made on the driver, as only there the schema's text can be read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl)).empty_table()
