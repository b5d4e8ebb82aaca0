"""Incremental ingestion: each micro-batch evolves the schema, then upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.model import AttributeType as A
from recordloom.model import RecordTable, quoted, tag
from recordloom.operators.inference import infer_schema
from recordloom.operators.write import latest
from recordloom.sinks.table import DEFAULT_BUCKETS, read_touched, upsert_table

TypedCell = Callable[[Column, A], Column]


def upsert_batch(
    batch: DataFrame,
    path: str,
    name: str,
    key: str,
    seq: str,
    cell_type: Callable[[Column], Column],
    typed_cell: TypedCell,
    version: int,
    buckets: int = DEFAULT_BUCKETS,
) -> RecordTable:
    """Infer, evolve and upsert one batch of text cells, as version ``version``.

    A row whose number is below that of the record's last row came late and changes types, but no values. The numbers
    are a table of their own beside the records, with versions of the same numbers.
    """
    attributes = [c for c in batch.columns if c not in (key, seq)]
    inferred = infer_schema(batch, {c: cell_type(quoted(c)) for c in attributes}, F.col(seq))
    spark, numbers = batch.sparkSession, f"{path.rstrip('/')}/sequence"
    rows = latest(batch, key, seq)
    known = read_touched(spark, numbers, "sequence", rows, key, version - 1)
    if known is not None:
        before = known.df.select(quoted(key).alias("known_key"), F.col("seq").alias("known_seq"))
        joined = rows.join(before, quoted(key) == F.col("known_key"), "left")
        rows = joined.where(F.col("known_seq").isNull() | (F.col(seq) > F.col("known_seq"))).drop("known_key", "known_seq")
    upsert_table(spark, numbers, "sequence", key, tag(rows.select(quoted(key), F.col(seq).cast("decimal(38,18)").alias("seq")), key), version, buckets)
    rows = rows.drop(seq)
    typed = rows.select(
        quoted(key),
        *[typed_cell(quoted(c), k).cast(k.stored.spark_type).alias(c) for c, k in inferred.items()],
    )
    return upsert_table(
        spark, path, name, key, tag(typed, key, inferred), version, buckets
    )


def start_upserts(
    stream: DataFrame,
    path: str,
    name: str,
    key: str,
    seq: str,
    cell_type: Callable[[Column], Column],
    typed_cell: TypedCell,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Keep a record table up to date with a stream of text cells.

    Version numbers follow the batch ids, and a batch reads the version before
    its own, so a batch that is run again after a failure has the same outcome.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_batch(batch, path, name, key, seq, cell_type, typed_cell, batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
