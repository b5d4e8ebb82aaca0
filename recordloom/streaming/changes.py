"""Upserts and deletes from a stream, in whatever order they arrive.

The stored table has registers (see ``recordloom.operators.registers``), so micro-batches commute: late operations change
only what no later one has decided, and tombstones keep deleted records from coming back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recordloom.model import RecordTable, tag
from recordloom.operators.registers import apply_piece, visible, with_registers
from recordloom.sinks.table import DEFAULT_BUCKETS, bucket_folders, read_buckets, read_table, touched_buckets, write_folder


def start_table(table: RecordTable, path: str, buckets: int = DEFAULT_BUCKETS) -> None:
    """Store ``table`` as what a stream of changes begins with."""
    write_folder(with_registers(table).df, f"{path.rstrip('/')}/version=0", table.primary_key, buckets, False)


def merge_piece(
    path: str, name: str, key: str, feed: DataFrame, columns: Sequence[str], version: int, given: str | None = None, buckets: int = DEFAULT_BUCKETS
) -> None:
    """Merge a piece of a feed into the stored table, as version ``version``.

    The version builds on the newest one before it, and only the buckets of the piece's ids are read and written, unless
    it brings a new attribute. Written again after a loss it is the same.
    """
    spark: SparkSession = feed.sparkSession
    path = path.rstrip("/")
    folders, count = bucket_folders(spark, path, version - 1)
    if not folders:
        empty = spark.createDataFrame([], f"`{key}` string")
        merged = apply_piece(RecordTable(name, tag(empty, key), key), feed, columns, given=given)
        write_folder(merged.df, f"{path}/version={version}", key, buckets, True)
        return
    whole = read_buckets(spark, folders, name)
    if set(columns) <= set(whole.df.columns):
        part = read_buckets(spark, folders, name, touched_buckets(feed, "record_id", count))
        write_folder(apply_piece(part, feed, columns, given=given).df, f"{path}/upsert={version}", key, count, True)
    else:
        write_folder(apply_piece(whole, feed, columns, given=given).df, f"{path}/version={version}", key, count, True)


def read_records(spark: SparkSession, path: str, name: str, version: int | None = None) -> RecordTable | None:
    """The records of a stored table with registers, without tombstones and registers."""
    table = read_table(spark, path, name, version)
    return None if table is None else visible(table)


def start_changes(
    stream: DataFrame, path: str, name: str, key: str, columns: Sequence[str], checkpoint: str, given: str | None = None, **trigger
) -> StreamingQuery:
    """Keep a stored table up to date with a stream of typed operations.

    ``stream`` has record_id, seq, operation (upsert or delete), the ``columns``, and ``given`` where upserts name what
    they set. Version numbers follow the batch ids, behind version 0 that ``start_table`` may have stored.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # read more than once: for its buckets, its numbers and its values
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                merge_piece(path, name, key, batch, columns, batch_id + 1, given)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
