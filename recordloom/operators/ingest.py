"""Merging typed records, whatever they came from, into a record table.

This is what an upload does: take the incoming types, evolve the table, bring the
incoming values to the evolved types, upsert.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.errors import Conflict, InvalidRelation
from recordloom.functions.relation import relation_id
from recordloom.model import META_TARGET, META_TYPE, Collection, RecordTable, check_name, quoted, tag, type_of
from recordloom.model import AttributeType as A
from recordloom.operators.edges import with_given_edges
from recordloom.operators.evolve import evolve, widen_to
from recordloom.operators.guards import check_guard, guarded_feed, guarded_records
from recordloom.operators.inference import relation_targets
from recordloom.operators.integrity import validate_relations
from recordloom.operators.write import upsert


def with_relations(records: DataFrame, table: RecordTable) -> DataFrame:
    """Records whose relation columns know their target types.

    Columns typed as relations hold URIs. Their targets are found, checked against
    each other and against the table, and kept as metadata; scalar relations then
    hold the bare id. One row per relation column reaches the driver.
    """
    kinds = {f.name: type_of(f) for f in records.schema.fields}
    related = {n: k for n, k in kinds.items() if k.base is A.RELATION}
    if not related:
        return records
    targets = relation_targets(records, related)
    validate_relations(table, targets)
    found = {r["attribute"]: r["target"] for r in targets.collect()}
    columns = []
    for f in records.schema.fields:
        c = quoted(f.name)
        if related.get(f.name) is A.RELATION:
            c = relation_id(c).alias(f.name, metadata=f.metadata)
        columns.append(c)
    return tag(records.select(*columns), relations=found)


def stored(records: DataFrame) -> DataFrame:
    """Records tagged as they will read back: what was all null is text."""
    columns = []
    for f in records.schema.fields:
        kind, meta = type_of(f), dict(f.metadata or {})
        if kind is not kind.stored:
            meta[META_TYPE] = kind.stored.value
        c = quoted(f.name)
        columns.append(c.alias(f.name, metadata=meta) if meta else c)
    return records.select(*columns)


def merge_records(
    table: RecordTable | None,
    name: str,
    key: str,
    records: DataFrame,
    guard: str | None = None,
    collection: Collection | None = None,
    unique: bool = False,
) -> RecordTable | tuple[RecordTable, DataFrame]:
    """The table after an upsert of typed, tagged ``records``; None makes a new one.

    Names of new attributes are checked, whatever the records came from. A key that
    is given twice fails the plan, unless ``unique`` says that none is. Array relations
    that the table holds as edges change there, by what the records give.

    With a ``guard``, relations of the records must name records of ``collection``:
    ``"refuse"`` fails otherwise, ``"report"`` writes the other records and returns
    the problems as well (see ``recordloom.operators.guards``).
    """
    check_guard(guard, collection)
    for attribute in records.columns:
        if attribute != key and (table is None or attribute not in table.types):
            check_name(attribute)
    if table is None:
        empty = RecordTable(name, records.select(quoted(key)), key)
        new = RecordTable(name, stored(tag(with_relations(records, empty), key)), key)
        if guard is None:
            return new
        nothing = new.with_df(new.df.limit(0))
        kept, problems = guarded_records(guard, collection, nothing, new.df)
        return new if problems is None else (new.with_df(kept), problems)
    if table.primary_key != key:
        raise Conflict(f"the primary key of {name} is {table.primary_key!r}, not {key!r}")
    records = with_relations(records, table)
    incoming = {f.name: type_of(f) for f in records.schema.fields if f.name != key}
    targets = {
        f.name: f.metadata[META_TARGET]
        for f in records.schema.fields
        if f.metadata and META_TARGET in f.metadata
    }
    held = [a for a in incoming if a in table.edge_tables]
    for attribute in held:
        if targets.get(attribute, table.relations[attribute]) != table.relations[attribute]:
            raise InvalidRelation(f"{attribute} refers to {table.relations[attribute]}")
    evolved = evolve(table, {a: k for a, k in incoming.items() if a not in held}, targets)
    final = evolved.types
    columns: list = [quoted(key)]
    for attribute, kind in incoming.items():
        c, target = quoted(attribute), final[attribute]
        if attribute in held:
            c, target = c.cast("array<string>"), A.ARRAY_OF_RELATION
        elif kind is A.NULL:
            c = F.lit(None)
        elif kind is A.EMPTY_ARRAY:
            c = F.when(c.isNotNull(), F.array() if target.is_array else F.lit("[]"))
        else:
            c = widen_to(c, kind, target)
        columns.append(c.cast(target.spark_type).alias(attribute))
    rows, problems = records.select(*columns), None
    if guard is not None:
        rows, problems = guarded_records(guard, collection, evolved, rows)
    after = with_given_edges(evolved.with_df(upsert(evolved, rows.drop(*held), unique=unique)), rows)
    return after if problems is None else (after, problems)


def apply_operations(
    table: RecordTable | None,
    name: str,
    ops: DataFrame,
    key: str,
    attributes: Sequence[str] | None = None,
    guard: str | None = None,
    collection: Collection | None = None,
) -> RecordTable | tuple[RecordTable, DataFrame]:
    """The table after a JSON change batch, in the order of its ``seq``.

    The schema is evolved once, over all upserts, and the operations then applied
    as one change feed. An operation on a record of another type is a conflict; one
    that names no type is taken to mean this table. ``split_by_type`` parts a batch
    of several types.

    With a ``guard``, relations that the batch leaves behind must name records, and
    records that it deletes must not be referred to: ``"refuse"`` fails otherwise,
    ``"report"`` leaves out all operations on the records with problems and returns
    the problems as well (see ``recordloom.operators.guards``).
    """
    check_guard(guard, collection)
    from recordloom.operators.evolve import create_type
    from recordloom.operators.write import apply_changes
    from recordloom.sources.operations import infer_operations, typed_feed

    strangers = ops.filter(F.col("type") != name).select("type").head(1)
    if strangers:
        raise Conflict(f"the batch for {name} has operations on {strangers[0]['type']!r}")
    inferred = {
        r["attribute"]: A(r["attribute_type"])
        for r in infer_operations(ops, attributes).collect()
        if r["attribute"] != key
    }
    names = sorted(inferred)
    if table is not None and (held := [n for n in names if n in table.edge_tables]):
        raise Conflict(f"{', '.join(held)} of {name} are held as edges, which records are merged into, not operations")
    known = table or create_type(ops.sparkSession, name, {}, key)
    raw = typed_feed(ops, inferred)
    related = {n: k for n, k in inferred.items() if k.base is A.RELATION}
    targets: dict[str, str] = {}
    if related:
        found = relation_targets(raw, related)
        validate_relations(known, found)
        targets = {r["attribute"]: r["target"] for r in found.collect()}
    evolved = evolve(known, inferred, targets)
    final = evolved.types
    feed = typed_feed(ops, {n: final[n] for n in names})
    for n, k in related.items():
        if k is A.RELATION:
            feed = feed.withColumn(n, relation_id(quoted(n)))
    if guard is None:
        return evolved.with_df(apply_changes(evolved, feed, names, given="given"))
    kept, problems = guarded_feed(
        guard, collection, evolved, feed, lambda rows: evolved.with_df(apply_changes(evolved, rows, names, given="given"))
    )
    after = evolved.with_df(apply_changes(evolved, kept, names, given="given"))
    return after if problems is None else (after, problems)
