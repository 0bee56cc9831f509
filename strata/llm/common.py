"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_dir

#: Text bytes worked on at once inside a task (numpy needs about 60 bytes per text byte).
CHUNK_BYTES = 1 << 20
#: The same where other large things are held besides.
SMALL_CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in
    files that every executor sees, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids joined by broadcast where at most so many (16 bytes each), else by shuffle.
BROADCAST_IDS = 1_000_000


def only(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with settled ``ids`` (both have ``key``),
    which are broadcast if they are few enough."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may inline a projected column into a lambda that reads it for
    every element; a one-element array bound to a lambda variable may not be."""
    return F.transform(F.array(value), body)[0]


#: Items of a block of ``running``.
_BLOCK = 256


def running(items: Column, zero: Column, step) -> Column:
    """The integer states before each of ``items``: ``zero``, ``step(zero,
    items[0])``, ... An array that grows by one copies itself each time; so one
    walk keeps the state before every block alone, and each block is walked
    again from there."""
    return let(items, lambda bound: _running(bound, zero, step))


def _running(items: Column, zero: Column, step) -> Column:
    none = F.array().cast("array<int>")

    def before_blocks(acc: Column, i: Column) -> Column:
        blocks = F.when(i % _BLOCK == 0, F.concat(acc["b"], F.array(acc["s"]))).otherwise(acc["b"])
        return F.struct(step(acc["s"], F.get(items, i)).cast("int").alias("s"), blocks.alias("b"))

    def inside(start: Column, block: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            state = step(acc["s"], F.get(items, i)).cast("int")
            return F.struct(state.alias("s"), F.concat(acc["b"], F.array(acc["s"])).alias("b"))

        places = F.sequence(block * _BLOCK, F.least(F.size(items), (block + 1) * _BLOCK) - 1)
        return F.aggregate(places, F.struct(start.alias("s"), none.alias("b")), one, lambda acc: acc["b"])

    first = F.struct(zero.cast("int").alias("s"), none.alias("b"))
    blocks = F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), first, before_blocks, lambda acc: acc["b"])
    return F.when(F.size(items) > 0, F.flatten(F.transform(blocks, inside))).otherwise(none)


def text_chunks(
    column: pa.Array, limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets); NULL reads as the empty text.
    A single longer text is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
