"""Job status kept up to date from a stream of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.jobs import fold_statuses


def start_status_fold(updates: DataFrame, checkpoint: str, sink, **trigger) -> StreamingQuery:
    """Fold ``(job_id, seq, status)`` updates; ``sink(rows, batch_id)`` gets changed jobs.

    Update mode sends each job that changed with its whole status, so a sink that
    overwrites by job id may see a batch twice.
    """
    folded = fold_statuses(updates)
    writer = folded.writeStream.outputMode("update").foreachBatch(sink)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
