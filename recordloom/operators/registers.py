"""Change feeds that may come in any order and any number of pieces.

A table with registers remembers, per record, the sequence numbers of its last upsert and its last delete, and per
attribute that of the upsert that set it last. A piece of a feed is reduced to the same registers and merged into them
attribute by attribute, the greater number wins, and a deleted record stays behind as a tombstone. So merging does not
depend on the order or the cutting of the feed, and a piece that is merged twice changes nothing: after all pieces the
records are those of ``apply_changes`` on the whole feed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.model import RecordTable, quoted

#: Reserved columns: the numbers of the last upsert and the last delete, and of each attribute's last upsert.
UPSERTED, DELETED, SET = "sys_upserted", "sys_deleted", "sys_set"
REGISTERS = (UPSERTED, DELETED, SET)
#: What a table held before any feed was set before all of it.
BEFORE = -1


def with_registers(table: RecordTable) -> RecordTable:
    """``table`` as it is before any piece of a feed; one that has registers already stays as it is."""
    if UPSERTED in table.df.columns:
        return table
    none = F.create_map().cast("map<string,bigint>")
    return table.with_df(table.df.select("*", F.lit(BEFORE).cast("long").alias(UPSERTED), F.lit(None).cast("long").alias(DELETED), none.alias(SET)))


def live() -> Column:
    """Whether a record is there: it was never deleted, or upserted since."""
    return F.col(DELETED).isNull() | F.coalesce(F.col(UPSERTED) > F.col(DELETED), F.lit(False))


def visible(table: RecordTable) -> RecordTable:
    """The records without tombstones and registers; an attribute that no upsert has set since the delete is null."""
    if UPSERTED not in table.df.columns:
        return table
    columns = []
    for name in table.df.columns:
        if name in REGISTERS:
            continue
        c = quoted(name)
        if name != table.primary_key:
            number = F.coalesce(F.element_at(SET, F.lit(name)), F.lit(BEFORE))
            c = F.when(F.col(DELETED).isNull() | (number > F.col(DELETED)), c)
        columns.append(c.alias(name, metadata=table.df.schema[name].metadata or {}))
    return table.with_df(table.df.where(live()).select(*columns))


def reduced(
    feed: DataFrame, columns: Sequence[str], record_id: str = "record_id", seq: str = "seq", operation: str = "operation", given: str | None = None
) -> DataFrame:
    """One row per id of a piece of a feed: ``new_key``, the last upsert and delete, and per column its number and value.

    Numbers are combined where rows are, by hash; values come by one join on the id and the number that won.
    """
    upsert = F.col(operation) == "upsert"
    sets = {c: upsert if given is None else upsert & F.coalesce(F.array_contains(given, c), F.lit(False)) for c in columns}
    rows = feed.select(
        F.col(record_id).alias("new_key"), F.col(seq).cast("long").alias("new_seq"), F.col(operation).alias("new_operation"),
        *[F.when(c, F.col(seq).cast("long")).alias(f"sets_{i}") for i, c in enumerate(sets.values())],
        *[quoted(c).alias(f"value_{i}") for i, c in enumerate(columns)],
    )
    last = rows.groupBy("new_key").agg(
        F.max(F.when(F.col("new_operation") == "upsert", F.col("new_seq"))).alias("new_upserted"),
        F.max(F.when(F.col("new_operation") == "delete", F.col("new_seq"))).alias("new_deleted"),
        *[F.max(f"sets_{i}").alias(f"new_set_{i}") for i in range(len(columns))],
    )
    if not columns:
        return last
    numbers = [f"new_set_{i}" for i in range(len(columns))]
    # the operations whose values count, at most one per column and id, meet the feed by id and number
    winners = last.select("new_key", *numbers, F.explode(F.array_distinct(F.array_compact(F.array(*numbers)))).alias("new_seq"))
    held = rows.where(F.col("new_operation") == "upsert").join(winners, ["new_key", "new_seq"])
    values = held.groupBy("new_key").agg(
        *[F.max_by(f"value_{i}", F.when(F.col(f"sets_{i}") == F.col(n), F.col("new_seq"))).alias(f"new_{i}") for i, n in enumerate(numbers)]
    )
    return last.join(values, "new_key", "left")


def apply_piece(
    table: RecordTable,
    feed: DataFrame,
    columns: Sequence[str],
    record_id: str = "record_id",
    seq: str = "seq",
    operation: str = "operation",
    given: str | None = None,
) -> RecordTable:
    """``table`` with registers after a piece of a feed; the arguments are those of ``apply_changes``.

    Sequence numbers are whole numbers from zero, no two operations on one id have the same. The table keeps tombstones:
    ``visible`` gives the records.
    """
    old = with_registers(table)
    key = old.primary_key
    new = reduced(feed, columns, record_id, seq, operation, given)
    joined = old.df.join(new, quoted(key) == F.col("new_key"), "full_outer")
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"new_set_{i}"))]
    fresh = F.map_filter(F.create_map(*pairs), lambda _, n: n.isNotNull()) if pairs else F.create_map().cast("map<string,bigint>")
    none = F.create_map().cast("map<string,bigint>")
    out = []
    for name in [*old.df.columns, *[c for c in columns if c not in old.df.columns]]:
        known = name in old.df.columns
        if name == key:
            c = F.coalesce(quoted(name), F.col("new_key"))
        elif name == UPSERTED:
            c = F.greatest(UPSERTED, "new_upserted")
        elif name == DELETED:
            c = F.greatest(DELETED, "new_deleted")
        elif name == SET:
            c = F.map_zip_with(F.coalesce(SET, none), fresh, lambda _, a, b: F.greatest(a, b))
        else:
            c = quoted(name) if known else F.lit(None)
            if name in columns:
                i = list(columns).index(name)
                before = F.coalesce(F.element_at(SET, F.lit(name)), F.lit(BEFORE))
                c = F.when(F.col(f"new_set_{i}") > before, F.col(f"new_{i}")).otherwise(c)
        metadata = old.df.schema[name].metadata if known else feed.schema[name].metadata
        out.append(c.alias(name, metadata=metadata or {}))
    return old.with_df(joined.select(*out))
