"""Upserts, deletes and ordered change batches as plans over record tables.

Nothing is updated in place: each function returns the table's next state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.errors import Conflict, MissingObject
from recordloom.model import Collection, RecordTable, quoted
from recordloom.operators.guards import check_guard, guarded_ids
from recordloom.operators.search import filter_ids


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row per key by sequence number, combined map-side."""
    others = [c for c in changes.columns if c != key]
    newest = changes.groupBy(key).agg(
        F.max_by(F.struct(*[quoted(c) for c in others]), seq).alias("row")
    )
    return newest.select(key, "row.*")


def once(key: Column) -> Column:
    """``key``, or an error where a row with the same key came before."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    twice = F.raise_error(F.concat(F.lit("a key is given more than once: "), key.cast("string")))
    return F.when(place == 1, key).otherwise(twice)


def upsert(
    table: RecordTable,
    changes: DataFrame,
    columns: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Insert or overwrite by key, touching only ``columns`` (default: all given).

    A null in a given column overwrites; columns not given keep their value, and
    are null in new records. A key that ``changes`` gives twice fails the plan where
    its rows meet for the join; ``unique`` says that none is, and saves the check.
    """
    key = table.primary_key
    given = [c for c in (columns or changes.columns) if c != key]
    old = table.df
    names = [*old.columns, *[c for c in given if c not in old.columns]]
    new = changes.select(
        (quoted(key) if unique else once(quoted(key))).alias("new_key"),
        *[quoted(c).alias(f"new_{i}") for i, c in enumerate(given)],
    )

    def merged(hit: Column) -> list[Column]:
        out = []
        for name in names:
            before = quoted(name) if name in old.columns else None
            if name == key:
                c = F.coalesce(before, F.col("new_key"))
            elif name in given:
                after = F.col(f"new_{given.index(name)}")
                c = F.when(hit, after) if before is None else F.when(hit, after).otherwise(before)
            else:
                c = before
            metadata = old.schema[name].metadata if name in old.columns else changes.schema[name].metadata
            out.append(c.alias(name, metadata=metadata or {}))
        return out

    hit = F.col("new_key").isNotNull()
    return old.join(new, quoted(key) == F.col("new_key"), "full_outer").select(*merged(hit))


def insert_missing(table: RecordTable, ids: DataFrame) -> DataFrame:
    """Add a record with nothing but its key for each of ``ids.record_id`` not yet there."""
    key = table.primary_key
    known = table.df.select(quoted(key).alias("old_key"))
    asked = ids.select("record_id").distinct()
    fresh = asked.join(known, F.col("record_id") == F.col("old_key"), "left_anti")
    fresh = fresh.select(F.col("record_id").alias(key))
    return table.df.unionByName(fresh, allowMissingColumns=True)


def replace_records(table: RecordTable, records: DataFrame) -> DataFrame:
    """Upsert in which every attribute not given becomes null."""
    key = table.primary_key
    missing = [c for c in table.df.columns if c not in records.columns]
    nulls = {c: F.lit(None).cast(table.df.schema[c].dataType) for c in missing}
    return upsert(table, records.withColumns(nulls) if nulls else records)


def patch_records(table: RecordTable, records: DataFrame, given: str | None = None) -> DataFrame:
    """Override given attributes of existing records; ids that do not exist are an error.

    ``given`` names an ``array<string>`` column listing the attributes a row sets;
    without it a row sets all columns it has.
    """
    key = table.primary_key
    unknown = records.select(quoted(key).alias("record_id")).join(
        table.df.select(quoted(key).alias("old_key")),
        F.col("record_id") == F.col("old_key"),
        "left_anti",
    )
    if not unknown.isEmpty():
        raise MissingObject("some records to patch do not exist")
    if given is None:
        return upsert(table, records)
    changed = [c for c in records.columns if c not in (key, given)]
    new = records.select(
        quoted(key).alias("new_key"),
        quoted(given).alias("new_given"),
        *[quoted(c).alias(f"new_{i}") for i, c in enumerate(changed)],
    )
    joined = table.df.join(new, quoted(key) == F.col("new_key"), "left")
    out = []
    for name in table.df.columns:
        c = quoted(name)
        if name in changed:
            sets = F.array_contains("new_given", name)
            c = F.when(sets, F.col(f"new_{changed.index(name)}")).otherwise(c)
        out.append(c.alias(name, metadata=table.df.schema[name].metadata or {}))
    return joined.select(*out)


# ---- deletes ---------------------------------------------------------------


def delete_ids(table: RecordTable, ids: DataFrame) -> DataFrame:
    wanted = ids.select(F.col("record_id").alias("gone"))
    return table.df.join(wanted, quoted(table.primary_key) == F.col("gone"), "left_anti")


def delete_all_except(table: RecordTable, keep: DataFrame | Sequence[str] = ()) -> DataFrame:
    return filter_ids(table, keep)


def delete_request(
    table: RecordTable,
    ids: DataFrame | None = None,
    delete_all: bool = False,
    excluded: DataFrame | None = None,
    guard: str | None = None,
    collection: Collection | None = None,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """A delete with the argument rules of the service: ids, or all but some.

    With a ``guard``, ids must exist and no record that stays may refer to them:
    ``"refuse"`` fails otherwise, ``"report"`` deletes the others and returns the
    problems as well (see ``recordloom.operators.guards``).
    """
    check_guard(guard, collection)
    if delete_all and ids is not None:
        raise Conflict("ids to delete and delete_all exclude each other")
    if excluded is not None and not delete_all:
        raise Conflict("excluded ids need delete_all")
    if ids is None and not delete_all:
        raise Conflict("name the ids to delete, or delete_all")
    if guard is not None:
        if ids is None:
            # all ids but the excluded ones, which the guard then judges like any others
            ids = table.df.select(quoted(table.primary_key).alias("record_id"))
            if excluded is not None:
                ids = ids.join(excluded.select("record_id"), "record_id", "left_anti")
        ids, problems = guarded_ids(guard, collection, table, ids)
        left = delete_ids(table, ids)
        return left if problems is None else (left, problems)
    if ids is not None:
        return delete_ids(table, ids)
    return delete_all_except(table, excluded if excluded is not None else ())


def missing_ids(table: RecordTable, ids: DataFrame) -> DataFrame:
    """Requested ids that name no record, for deletes that must hit."""
    known = table.df.select(quoted(table.primary_key).alias("old_key"))
    asked = ids.select("record_id").distinct()
    return asked.join(known, F.col("record_id") == F.col("old_key"), "left_anti")


# ---- ordered change feeds --------------------------------------------------


def apply_changes(
    table: RecordTable,
    feed: DataFrame,
    columns: Sequence[str],
    record_id: str = "record_id",
    seq: str = "seq",
    operation: str = "operation",
    given: str | None = None,
) -> DataFrame:
    """Apply upserts and deletes in sequence order.

    ``given`` names an ``array<string>`` column of the attributes each upsert
    sets; its other attributes keep what they hold. Without ``given`` every upsert
    sets all ``columns``.

    Per id one combinable aggregation keeps the last delete and, per column, the
    last upsert that set it, so a hot id costs one buffer per task. The result is
    then merged with the existing records in one join.
    """
    key = table.primary_key
    flags = {c: f"sets_{i}" for i, c in enumerate(columns)}
    sets = {f: F.lit(True) if given is None else F.coalesce(F.array_contains(given, c), F.lit(False)) for c, f in flags.items()}
    rows = feed.withColumns(sets)
    is_upsert = F.col(operation) == "upsert"
    is_delete = F.col(operation) == "delete"
    last = rows.groupBy(F.col(record_id).alias("new_key")).agg(
        F.max(F.when(is_delete, F.col(seq))).alias("deleted"),
        F.max(F.when(is_upsert, F.col(seq))).alias("upserted"),
        *[
            F.max_by(
                F.struct(F.col(seq).alias("seq"), quoted(c).alias("value")),
                F.when(is_upsert & F.col(f), F.col(seq)),
            ).alias(f)
            for c, f in flags.items()
        ],
    )
    joined = table.df.join(last, quoted(key) == F.col("new_key"), "full_outer")
    gone = F.coalesce(F.col("deleted") > F.coalesce("upserted", F.lit(-1)), F.lit(False))
    out = []
    for name in [*table.df.columns, *[c for c in columns if c not in table.df.columns]]:
        known = name in table.df.columns
        before = quoted(name) if known else F.lit(None)
        if name == key:
            c = F.coalesce(before, F.col("new_key"))
        else:
            # a delete wipes what the table held
            c = F.when(F.col("deleted").isNull(), before)
            if name in flags:
                setter = F.col(flags[name])
                live = setter.isNotNull() & (
                    F.col("deleted").isNull() | (setter["seq"] > F.col("deleted"))
                )
                c = F.when(live, setter["value"]).otherwise(c)
        metadata = table.df.schema[name].metadata if known else feed.schema[name].metadata
        out.append(c.alias(name, metadata=metadata or {}))
    return joined.filter(~gone).select(*out)


def split_by_type(
    df: DataFrame, types: Sequence[str] | None = None, column: str = "type"
) -> Mapping[str, DataFrame]:
    """One plan per record type; each is a filter the scan can push down.

    Without ``types`` they are those that occur; a null type is none of them.
    """
    if types is None:
        types = sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)
    return {t: df.filter(F.col(column) == t).drop(column) for t in types}
