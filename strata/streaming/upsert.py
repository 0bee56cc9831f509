"""Incremental upsert with Structured Streaming.

Landed files are read with the file stream source (``maxFilesPerTrigger``
splits a backlog into micro-batches). The stream's state holds, by key, the row of
the highest version so far and the partitions in which rows of the key were seen;
in update mode a micro-batch emits the keys it touched alone, and ``foreachBatch``
merges them into a ``KeyedTable``. A late row never gets past the state, and the
merge reads and rewrites only partitions of emitted keys: neither the table nor
its key columns are read whole.

That the partitions of a key are known holds if the stream, from the start of
its checkpoint, is the table's only writer (``exclusive``). Otherwise, such as on a
table that held rows before, or with a new checkpoint, the merge looks the keys
up. Micro-batches may be repeated: a row whose version is not higher than the
stored one changes nothing.

State is one row a key, as the table; ``spark.sql.streaming.stateStore.providerClass``
may name Spark's RocksDB provider to keep it off the heap.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.sources.keyed import KeyedTable, Merge, merge_into
from strata.sources.sinks import materialize

PLACES = "places__"


def latest_with_places(rows: DataFrame, table: KeyedTable, version_by: Sequence[str]) -> DataFrame:
    """By key: the row of the highest version, and all partitions seen."""
    payload = F.struct(*[c for c in table.schema.fieldNames() if c not in table.keys])
    best = table.placed(rows).groupBy(*table.keys).agg(
        F.max_by(payload, F.struct(*version_by)).alias("w__"), F.collect_set(table.partition).alias(PLACES)
    )
    return best.select(*table.keys, "w__.*", PLACES)


def merge_batch_fn(
    table: KeyedTable, version_by: Sequence[str], exclusive: bool, report: Callable[[int, Merge], None] | None = None
):
    def merge(batch: DataFrame, epoch_id: int) -> None:
        # the merge reads the batch more than once; the stream's state is worked out once
        batch = materialize(batch, "micro-batch")
        done = merge_into(table, batch, version_by, updates_win=False, places=PLACES if exclusive else None)
        if report is not None:
            report(epoch_id, done)

    return merge


def stream_upsert(
    spark: SparkSession,
    source_dir: str,
    table: KeyedTable,
    version_by: Sequence[str],
    checkpoint_dir: str,
    exclusive: bool = False,
    fmt: str = "parquet",
    max_files_per_trigger: int = 1,
    interval: str | None = None,
    report: Callable[[int, Merge], None] | None = None,
) -> StreamingQuery:
    """Start the upsert stream. Without ``interval`` it drains the backlog in
    micro-batches and stops; with one (such as "30 seconds") it goes on.
    ``report`` gets the number and the ``Merge`` of every micro-batch."""
    stream = (
        spark.readStream.schema(table.schema)
        .format(fmt)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(source_dir)
    )
    writer = (
        latest_with_places(stream, table, version_by)
        .writeStream.outputMode("update")
        .foreachBatch(merge_batch_fn(table, version_by, exclusive, report))
        .option("checkpointLocation", checkpoint_dir)
        .queryName(f"upsert_{zlib.crc32(table.path.encode()):08x}")
    )
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
