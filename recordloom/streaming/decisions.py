"""A decision for every status update on a stream, and an error for jobs that fall silent.

Each job's state is kept in the state store: its status and the time of its last update. An update leaves the
stream as soon as it arrives, as accepted, ignored (it says what is known) or rejected (the job has ended, or what it says
is no end). A timer per open job, moved on by each update, ends it with an error once no update came for long enough.

Jobs are dealt into lots by hash. A lot's states go to Python and back in one piece, beside its updates and with one timer for
all, so that a job costs no calls to the state store of its own; a lot that has updates is written again whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordloom.constants import STALLED_AFTER_HOURS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a decision row has; ``seq`` is null where a timer decided.
DECISIONS = "job_id string, seq long, status string, decision string"
ACCEPTED, IGNORED, REJECTED, STALLED = "accepted", "ignored", "rejected", "stalled"
#: Jobs whose states are kept as one: a checkpoint holds for this number.
LOTS = 4096
OPEN, FINAL = "RUNNING", ("SUCCEEDED", "ERROR")


def _decider(patience: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Decisions on the updates of one lot of jobs; ``patience`` in milliseconds, or None for no timers."""

    def decide_lot(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # status and timer by job
        jobs = pickle.loads(state.get[0]) if state.exists else {}
        updates: dict[str | None, list[tuple]] = {}
        if not state.hasTimedOut:
            for part in parts:
                for job, *row in zip(*(part[c].tolist() for c in ("job_id", "seq", "status", "ms")), strict=True):
                    updates.setdefault(job, []).append(row)
        out = []
        for job, rows in updates.items():
            status, timer = jobs.get(job, (OPEN, None))
            # a micro-batch has no order; the source bounds how many rows it holds
            if len(rows) > 1:
                rows.sort(key=lambda r: int(r[0]))
            for seq, said, _ in rows:
                if status == OPEN and said in FINAL:
                    status, decision = said, ACCEPTED
                else:
                    decision = IGNORED if said == status else REJECTED
                out.append((job, None if seq is None else int(seq), said, decision))
            if patience is None or status != OPEN:
                timer = None
            else:
                timer = max(timer or 0, max(int(r[2]) for r in rows) + patience)
            jobs[job] = status, timer
        if patience is not None:
            now = state.getCurrentWatermarkMs()
            for job in [j for j, (_, timer) in jobs.items() if timer is not None and timer < now]:
                jobs[job] = "ERROR", None
                out.append((job, None, "ERROR", STALLED))
            timers = [timer for _, timer in jobs.values() if timer is not None]
            if timers:
                state.setTimeoutTimestamp(max(min(timers), now + 1))
        state.update((pickle.dumps(jobs),))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "seq", "status", "decision"], dtype=object)

    return decide_lot


def decide(updates: DataFrame, stalled_after: timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """Decisions (see ``DECISIONS``) on a stream of updates ``(job_id, seq, status)``, in append mode.

    Updates count in the order of seq within a micro-batch, and as they arrive between batches. With ``stalled_after``
    updates have a time ``updated`` as well: a job that has not ended, and has no update for so long in the updates' own
    time, is decided to be stalled, with ERROR for its status. ``late`` is how far behind the latest one
    an update may come; those that come later still are left out. The session's state store must be RocksDB (``STATE_STORE``).
    """
    # numbers as text, since pandas would make numbers beside nulls inexact
    seq = F.col("seq").cast("string").alias("seq")
    if stalled_after is None:
        rows, mode, patience = updates.select("job_id", seq, "status", F.lit(0).cast("long").alias("ms")), GroupStateTimeout.NoTimeout, None
    else:
        timed = updates.withWatermark("updated", late)
        rows = timed.select("job_id", seq, "status", F.unix_millis("updated").alias("ms"), "updated")
        mode, patience = GroupStateTimeout.EventTimeTimeout, int(stalled_after / timedelta(milliseconds=1))
    lots = rows.withColumn("lot", F.pmod(F.xxhash64("job_id"), F.lit(LOTS)))
    return lots.groupBy("lot").applyInPandasWithState(_decider(patience), DECISIONS, "jobs binary", "append", mode)


def start_decisions(
    updates: DataFrame, path: str, checkpoint: str, stalled_after: timedelta | None = timedelta(hours=STALLED_AFTER_HOURS), late: str = "0 seconds", **trigger
) -> StreamingQuery:
    """Write decisions to Parquet below ``path`` as they are made, each once; taken up again from ``checkpoint``."""
    spark = updates.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = decide(updates, stalled_after, late).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
