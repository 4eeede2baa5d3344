"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from textloom.session import bound_batches, ship_package

BATCH_BYTES = 2 << 20
PIECE = 250_000  # bytes of a batch that a function looks at together: its arrays take some 60 times that


def ship(spark: SparkSession) -> None:
    """Workers import this package by name, and Arrow batches of whole texts take bounded memory on both sides."""
    bound_batches(spark, BATCH_BYTES)
    ship_package(spark)


#: Functions that let go what a worker keeps between the tasks of the token operators.
KEPT: list[Callable[[], None]] = []


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class tidy:
    """A function of a task's batches that gives free memory back to the system when the task ends: workers live on, and
    what one stage has taken would count against the next one's. So does what is kept, unless the function uses it
    (``keep``)."""

    def __init__(self, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False):
        self.fn, self.keep = fn, keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if KEPT and not self.keep:
            for drop in KEPT:
                drop()
            _give_back()
        try:
            yield from self.fn(batches)
        finally:
            _give_back()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema, limit: int = PIECE, keep: bool = False) -> DataFrame:
    """mapInArrow with a function of one batch, sliced so that a batch holds a bounded number of bytes."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit):
                yield from fn(part)

    return df.mapInArrow(tidy(run, keep), schema)


def slices(batch: pa.RecordBatch, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes (the row that goes beyond is the last of its run)."""
    if batch.nbytes <= limit or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    weight = np.ones(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            weight += np.diff(offsets_of(c)) + 4
        else:
            weight += c.nbytes // batch.num_rows
    ends = np.searchsorted(np.cumsum(weight), np.arange(limit, int(weight.sum()) + limit, limit), "left") + 1
    at = 0
    for e in np.unique(np.minimum(ends, batch.num_rows)):
        if e > at:
            yield batch.slice(at, e - at)
            at = e
    if at < batch.num_rows:
        yield batch.slice(at)


SMALL_BYTES = 48 << 20


def row_bytes(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + row_bytes(x, kind.elementType)), F.lit(16))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, MapType):
        return row_bytes(F.map_keys(c), ArrayType(kind.keyType)) + row_bytes(F.map_values(c), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((row_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take in memory; give a frame that is written already."""
    size = sum((row_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df``, marked to be sent to all tasks if its rows are proved to take ``most`` bytes at most; beyond that the
    a sort-merge join takes over, as the optimizer's own rule counts compressed bytes. Give a frame that is written
    already, as it is measured first."""
    return F.broadcast(df) if bytes_of(df) <= most else df.hint("merge")


def offsets_of(a: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def held_out(doc_id) -> object:
    """The contract's fold: crc32(doc_id as text) mod 4 is 2; a null doc_id is held out as well, as it has no crc."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
