"""Checks between records as part of a write.

A guard looks at what a write changes and nothing else: the relations of the records that come in, and the references to
the records that go. Their ids drive every join. The tables on the other side are cut down to these ids by a semi join
before anything of them is counted or matched, so Spark can send small change sets to them, or a Bloom filter of the ids
where the change set is large.

With ``"refuse"`` a write with problems fails and changes nothing. With ``"report"`` the records with problems are set
aside, the others are written, and the problems are returned beside the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.errors import Conflict, InvalidRelation
from recordloom.model import Collection, RecordTable, quoted
from recordloom.operators.integrity import blocked_deletes, referrers, relation_pairs
from recordloom.session import shared_dir

REFUSE, REPORT = "refuse", "report"
#: Problems named in the message of a refused write.
_NAMED = 5

PROBLEMS = "record_id string, attribute string, target string, problem string, references long"


def check_guard(guard: str | None, collection: Collection | None) -> None:
    if guard not in (None, REFUSE, REPORT):
        raise Conflict(f"a guard is {REFUSE!r} or {REPORT!r}, not {guard!r}")
    if guard is not None and collection is None:
        raise Conflict("a guard needs the collection that records relate to")


def _keys(table: RecordTable, asked: DataFrame) -> DataFrame:
    """Those of ``asked.to_id`` that are keys of ``table``; the table is cut down to them first."""
    keys = table.df.select(quoted(table.primary_key).alias("key"))
    return keys.join(asked, F.col("key") == F.col("to_id"), "left_semi").select(F.col("key").alias("to_id"))


def _problem(record: Column, attribute: str, target: Column, problem: str, references: Column) -> list[Column]:
    return [
        record.alias("record_id"), F.lit(attribute).alias("attribute"), target.alias("target"), F.lit(problem).alias("problem"),
        references.cast("long").alias("references"),
    ]


def dangling_changes(collection: Collection, table: RecordTable, records: DataFrame) -> DataFrame:
    """Relations of ``records``, which are to be written to ``table``, that name no record.

    ``table`` has the schema after the write. A relation to the table itself may name a record that comes in as well.
    Rows are problems: record_id, attribute, target, problem and references.
    """
    found = None
    known = table.df.schema
    typed = [quoted(c).alias(c, metadata=known[c].metadata) if c in known.names else quoted(c) for c in records.columns]
    incoming = table.with_df(records.select(*typed))
    for relation, target in sorted(table.relations.items()):
        if relation not in records.columns:
            continue
        pairs = relation_pairs(RecordTable(table.name, incoming.df, table.primary_key), relation).where(F.col("to_id").isNotNull())
        asked = pairs.select("to_id")
        there = _keys(table if target == table.name else collection[target], asked)
        if target == table.name:
            there = there.union(_keys(incoming, asked))
        missing = pairs.join(there.distinct(), "to_id", "left_anti")
        rows = missing.select(*_problem(F.col("from_id"), relation, F.col("to_id"), "names no record", F.lit(None)))
        found = rows if found is None else found.unionByName(rows)
    return records.sparkSession.createDataFrame([], PROBLEMS) if found is None else found


def delete_problems(collection: Collection, table: RecordTable, ids: DataFrame, missing: bool = True) -> DataFrame:
    """Why records in ``ids.record_id`` can't be deleted: they don't exist, or records that stay refer to them.

    References of records that are deleted as well don't count.
    """
    asked = ids.select(F.col("record_id")).distinct()
    blocked = blocked_deletes(collection.replace(table), table.name, asked, leaving=asked)
    none = F.lit(None).cast("string")
    rows = blocked.select(*_problem(F.col("record_id"), "", none, "is referred to", F.col("references")))
    if missing:
        there = _keys(table, asked.select(F.col("record_id").alias("to_id")))
        unknown = asked.join(there.select(F.col("to_id").alias("record_id")), "record_id", "left_anti")
        rows = rows.unionByName(unknown.select(*_problem(F.col("record_id"), "", none, "does not exist", F.lit(None))))
    return rows.withColumn("attribute", F.nullif(F.col("attribute"), F.lit("")))


def refuse(problems: DataFrame, what: str, error: type[Exception] = Conflict) -> None:
    """Raise ``error`` if there are problems, naming the first few."""
    rows = problems.orderBy("record_id", "attribute", "target").limit(_NAMED).collect()
    if rows:
        named = "; ".join(" ".join(str(v) for v in (r["record_id"], r["attribute"], r["target"], r["problem"]) if v is not None) for r in rows)
        raise error(f"{what}: {named}")


def set_aside(rows: DataFrame, key: str, check: Callable[[DataFrame], DataFrame], again: bool) -> tuple[DataFrame, DataFrame]:
    """``rows`` without those that ``check`` finds problems with, and the problems.

    Where rows may rely on each other (``again``), those left are checked until none has a problem; a round is needed
    for each step of a chain of records that rely on one another. Each round's problems are a table in the shared folder.
    """
    spark = rows.sparkSession
    found = None
    while True:
        path = f"{shared_dir(spark).rstrip('/')}/problems-{uuid.uuid4().hex}"
        check(rows).write.parquet(path)
        new = spark.read.schema(PROBLEMS).parquet(path)
        found = new if found is None else found.unionByName(new)
        if new.isEmpty():
            return rows, found
        bad = new.select(F.col("record_id").alias("sys_bad")).distinct()
        rows = rows.join(bad, quoted(key) == F.col("sys_bad"), "left_anti")
        if not again:
            return rows, found


def guarded_records(
    guard: str, collection: Collection, table: RecordTable, records: DataFrame
) -> tuple[DataFrame, DataFrame | None]:
    """The records that may be written to ``table``, which has the schema after the write, and the problems of others."""

    def check(rows: DataFrame) -> DataFrame:
        return dangling_changes(collection, table, rows)

    if guard == REFUSE:
        refuse(check(records), f"relations of {table.name} dangle", InvalidRelation)
        return records, None
    return set_aside(records, table.primary_key, check, table.name in table.relations.values())


def guarded_ids(guard: str, collection: Collection, table: RecordTable, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The ids that may be deleted, and the problems of others."""

    def check(rows: DataFrame) -> DataFrame:
        return delete_problems(collection, table, rows)

    if guard == REFUSE:
        refuse(check(ids), f"records of {table.name} can't be deleted")
        return ids, None
    to_itself = any(source == table.name for source, _ in referrers(collection.replace(table), table.name))
    return set_aside(ids.select("record_id").distinct(), "record_id", check, to_itself)


def guarded_feed(
    guard: str, collection: Collection, before: RecordTable, feed: DataFrame, applied: Callable[[DataFrame], RecordTable]
) -> tuple[DataFrame, DataFrame | None]:
    """The operations on ``before`` (record_id and others) that may be ``applied``, and the problems of others.

    What counts is the state after all operations: a record that is deleted and comes back has not gone.
    """
    key = before.primary_key

    def check(rows: DataFrame) -> DataFrame:
        after = applied(rows)
        ids = rows.select(F.col("record_id").alias("to_id"))
        changed = after.df.join(ids, quoted(key) == F.col("to_id"), "left_semi")
        dangling = dangling_changes(collection, after, changed)
        gone = _keys(before, ids).join(_keys(after, ids), "to_id", "left_anti").select(F.col("to_id").alias("record_id"))
        return dangling.unionByName(delete_problems(collection, after, gone, missing=False))

    if guard == REFUSE:
        refuse(check(feed), f"operations on {before.name} leave relations that dangle", InvalidRelation)
        return feed, None
    return set_aside(feed, "record_id", check, again=True)
