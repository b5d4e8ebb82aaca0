"""Jobs, their status updates, and activity events as tables and streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.constants import (
    EXTERNAL_STATUS,
    IMPORT_SCHEMES,
    NONTERMINAL_STATUSES,
    STALLED_AFTER_HOURS,
    TERMINAL_STATUSES,
)


def jobs_of(jobs: DataFrame, collection_id: str | None = None, statuses: Sequence[str] | None = None) -> DataFrame:
    if collection_id is not None:
        jobs = jobs.filter(F.col("collection_id") == collection_id)
    return jobs if statuses is None else jobs.filter(F.col("status").isin(*statuses))


def stalled_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Unfinished jobs without an update for too long, with the error they get."""
    limit = F.expr(f"interval {STALLED_AFTER_HOURS} hours")
    open_ = F.col("status").isin(*NONTERMINAL_STATUSES)
    message = f"no update for {STALLED_AFTER_HOURS} hours"
    return jobs.filter(open_ & (F.col("updated") < now - limit)).withColumns(
        {"status": F.lit("ERROR"), "error": F.lit(message)}
    )


def job_status(external: Column) -> Column:
    """Job status of an external one; none given is unknown, a strange one an error."""
    status = F.when(external.isNull(), "UNKNOWN")
    for name, meaning in EXTERNAL_STATUS.items():
        status = status.when(external == name, meaning)
    return status.otherwise(F.raise_error(F.concat(F.lit("unknown status: "), external)))


def fold_statuses(updates: DataFrame) -> DataFrame:
    """Each job's status after all its updates ``(job_id, seq, status)``.

    Only success and error are ever accepted, and the first of them is final, so
    the outcome is the earliest of those: one aggregation that combines map-side
    and runs unchanged on a stream in update mode. Its buffers are two numbers, so
    jobs are told apart by hash and nothing is sorted.
    """

    def first(status: str) -> Column:
        return F.min(F.when(F.col("status") == status, F.col("seq")))

    done, failed = first("SUCCEEDED"), first("ERROR")
    outcome = F.when(done.isNull() & failed.isNull(), "RUNNING").when(failed.isNull() | (done < failed), "SUCCEEDED")
    return updates.groupBy("job_id").agg(
        outcome.otherwise("ERROR").alias("status"), F.least(done, failed).alias("finished_at")
    )


def classify_updates(updates: DataFrame) -> DataFrame:
    """Per job, how many updates were accepted, ignored as no change, or rejected."""
    final = fold_statuses(updates).select(
        F.col("job_id").alias("folded_id"), F.col("status").alias("final_status"), "finished_at"
    )
    rows = updates.select("job_id", "seq", "status").join(
        final, F.col("job_id") == F.col("folded_id")
    )
    before = F.col("finished_at").isNull() | (F.col("seq") < F.col("finished_at"))
    accepted = F.col("seq") == F.col("finished_at")
    current = F.when(before, F.lit("RUNNING")).otherwise(F.col("final_status"))
    same = ~F.coalesce(accepted, F.lit(False)) & (F.col("status") == current)
    return rows.groupBy("job_id").agg(
        F.count_if(accepted).alias("accepted"),
        F.count_if(same).alias("ignored"),
        F.count_if(~F.coalesce(accepted, F.lit(False)) & ~same).alias("rejected"),
    )


def elapsed_by_tags(jobs: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Count, mean and longest run time in seconds of finished jobs."""
    seconds = (
        F.unix_micros(F.col("updated").cast("timestamp"))
        - F.unix_micros(F.col("created").cast("timestamp"))
    ) / 1_000_000
    done = jobs.filter(F.col("status").isin(*TERMINAL_STATUSES))
    return done.groupBy(*tags).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.avg(seconds).alias("mean_seconds"),
        F.max(seconds).alias("max_seconds"),
    )


def activity_text(
    subject: Column,
    action: Column,
    thing: Column,
    quantity: Column | None = None,
    record_type: Column | None = None,
    ids: Column | None = None,
) -> Column:
    """The log line of an activity event; parts that are null are left out."""

    def part(*pieces) -> Column:
        return F.coalesce(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]), F.lit(""))

    none = F.lit(None).cast("string")
    ids = F.lit(None).cast("array<string>") if ids is None else ids
    quantity = none if quantity is None else quantity
    number = F.coalesce(F.when(ids.isNotNull(), F.size(ids)).cast("string"), quantity.cast("string"))
    listed = F.concat(F.lit("["), F.array_join(ids, ", ", "null"), F.lit("]"))
    return F.concat(
        part("user ", subject, " ", action),
        part(" ", number),
        part(" ", thing, "(s)"),
        part(" of type ", none if record_type is None else record_type),
        part(" with id(s) ", listed),
    )


def activity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action", "thing", "record_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("quantity").alias("quantity")
    )


# ---- where imports may come from -------------------------------------------


@dataclass(frozen=True)
class ImportSource:
    """A known source: its URL patterns and what importing from it requires."""

    urls: tuple[str, ...]
    private_workspace: bool = False
    protected_policy: bool = False
    groups: tuple[str, ...] = ()
    always_apply_groups: bool = True


def _any(conditions) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def check_imports(
    requests: DataFrame,
    allowed_hosts: Mapping[str, Sequence[str]],
    sources: Sequence[ImportSource] = (),
    url: str = "url",
    import_type: str = "import_type",
) -> DataFrame:
    """Each request with whether its URL is allowed, why not, and what it requires.

    The rules are configuration, so they become expressions over the request:
    nothing is joined or shuffled.
    """
    u = F.col(url)
    scheme = F.nullif(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit(""))
    host = F.regexp_extract(u, r"^[^:/?#]+://(?:[^/?#@]*@)?([^:/?#]*)", 1)
    scheme_ok = _any(
        (F.col(import_type) == kind) & scheme.isin(*schemes)
        for kind, schemes in IMPORT_SCHEMES.items()
    )
    host_ok = _any(
        (scheme == name) & host.rlike(f"^(?:{pattern})$")
        for name, patterns in allowed_hosts.items()
        for pattern in patterns
    )
    matches = [_any(u.rlike(p) for p in s.urls) for s in sources]
    listed = _any(matches)
    problem = (
        F.when(scheme.isNull(), "not an absolute URL")
        .when(~scheme_ok, F.concat(F.lit("scheme not allowed: "), scheme))
        .when(~host_ok & ~listed, F.concat(F.lit("host not allowed: "), host))
    )

    def required(flag: str) -> Column:
        return _any(m for m, s in zip(matches, sources, strict=True) if getattr(s, flag))

    groups = [
        F.when(m, F.array(*[F.lit(g) for g in s.groups])).otherwise(F.array().cast("array<string>"))
        for m, s in zip(matches, sources, strict=True)
        if s.groups
    ]
    return requests.withColumns(
        {
            "allowed": problem.isNull(),
            "problem": problem,
            "private_workspace": required("private_workspace"),
            "protected_policy": required("protected_policy"),
            "required_groups": F.concat(*groups) if groups else F.array().cast("array<string>"),
            "always_apply_groups": required("always_apply_groups"),
        }
    )
