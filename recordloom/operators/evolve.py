"""Schema operators: creating, widening, renaming, dropping, describing.

All of them work on the schema, which is driver-side metadata; the plans they
return only project.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.constants import DEFAULT_PRIMARY_KEY, RESERVED_PREFIX
from recordloom.errors import Conflict, InvalidName, InvalidRelation, MissingObject, UnsupportedConversion
from recordloom.functions.convert import convert, is_supported
from recordloom.functions.jsontext import value_json
from recordloom.model import META_KEY, META_TARGET, META_TYPE, Collection, RecordTable, check_name, quoted
from recordloom.model import AttributeType as A
from recordloom.operators.inference import select_best_type
from recordloom.operators.integrity import referrers


def create_type(
    spark: SparkSession,
    name: str,
    schema: Mapping[str, A],
    primary_key: str = DEFAULT_PRIMARY_KEY,
    relations: Mapping[str, str] | None = None,
) -> RecordTable:
    """An empty record table with the given attributes."""
    check_name(name)
    fields = [T.StructField(primary_key, T.StringType(), True, {META_KEY: True})]
    for attribute in sorted(a for a in schema if a != primary_key):
        kind = schema[attribute].stored
        meta = {META_TYPE: kind.value}
        if attribute in (relations or {}):
            meta[META_TARGET] = relations[attribute]
        fields.append(T.StructField(check_name(attribute), kind.spark_type, True, meta))
    return RecordTable(name, spark.createDataFrame([], T.StructType(fields)), primary_key)


@dataclass(frozen=True)
class SchemaDiff:
    """What a batch of records would change in a table."""

    only_new: dict[str, A]
    differing: dict[str, tuple[A, A]]


def schema_diff(existing: Mapping[str, A], incoming: Mapping[str, A]) -> SchemaDiff:
    return SchemaDiff(
        {n: t for n, t in incoming.items() if n not in existing},
        {n: (existing[n], t) for n, t in incoming.items() if existing.get(n, t) is not t},
    )


def add_columns(table: RecordTable, new: Mapping[str, A], targets: Mapping[str, str] | None = None) -> RecordTable:
    """The table with null columns for new attributes."""
    for name in new:
        if name.startswith(RESERVED_PREFIX):
            raise InvalidName(f"attribute names may not start with {RESERVED_PREFIX}")
    columns = [quoted(c) for c in table.df.columns]
    for name, kind in new.items():
        meta = {META_TYPE: kind.stored.value}
        if name in (targets or {}):
            meta[META_TARGET] = targets[name]
        null = F.lit(None).cast(kind.stored.spark_type)
        columns.append(null.alias(check_name(name), metadata=meta))
    return table.with_df(table.df.select(*columns))


def widen_column(table: RecordTable, column: str, incoming: A) -> RecordTable:
    """The table with ``column`` of the type that holds old and incoming values."""
    existing = table.type(column)
    if existing.base is A.RELATION:
        raise InvalidRelation("the type of a relation attribute cannot change")
    chosen = select_best_type(existing, incoming)
    return table if chosen is existing else _retype(table, column, chosen)


def evolve(table: RecordTable, incoming: Mapping[str, A], targets: Mapping[str, str] | None = None) -> RecordTable:
    """Add the attributes a batch brings and widen those it contradicts."""
    known = {n: t for n, t in table.types.items() if n != table.primary_key}
    diff = schema_diff(known, {n: t for n, t in incoming.items() if n != table.primary_key})
    table = add_columns(table, diff.only_new, targets)
    for column, (_, new) in diff.differing.items():
        table = widen_column(table, column, new)
    return table


def widen_to(c, source: A, target: A):
    """Old values as the wider type, for pairs that only ever widen."""
    if source is target:
        return c
    if is_supported(source, target):
        return convert(c, source, target)
    if target is A.STRING:
        return value_json(c, source) if source.is_array or source is A.JSON else c.cast("string")
    if target is A.ARRAY_OF_STRING and source.is_array:
        base = source.base
        return c if base in (A.STRING, A.FILE, A.RELATION, A.JSON, A.NULL) else F.transform(
            c, lambda e: convert(e, base, A.STRING)
        )
    raise UnsupportedConversion(f"cannot widen {source.value} to {target.value}")


def _retype(table: RecordTable, column: str, target: A) -> RecordTable:
    columns = []
    for f in table.df.schema.fields:
        c = quoted(f.name)
        if f.name == column:
            meta = {**(f.metadata or {}), META_TYPE: target.value}
            c = widen_to(c, table.type(column), target).cast(target.spark_type)
            c = c.alias(f.name, metadata=meta)
        columns.append(c)
    return table.with_df(table.df.select(*columns))


def convert_attribute(table: RecordTable, column: str, target: A) -> RecordTable:
    """The table with the values of ``column`` converted; one bad value fails the job."""
    _changeable(table, column)
    source = table.type(column)
    columns = []
    for f in table.df.schema.fields:
        c = quoted(f.name)
        if f.name == column:
            c = convert(c, source, target).cast(target.spark_type)
            c = c.alias(f.name, metadata={META_TYPE: target.value})
        columns.append(c)
    return table.with_df(table.df.select(*columns))


def _changeable(table: RecordTable, column: str) -> None:
    if column == table.primary_key:
        raise Conflict("the primary key cannot be changed")
    if column not in table.types:
        raise MissingObject(f"{table.name} has no attribute {column!r}")


def rename_attribute(table: RecordTable, column: str, new_name: str) -> RecordTable:
    _changeable(table, column)
    if new_name in table.types:
        raise Conflict(f"attribute {new_name!r} already exists")
    return table.with_df(table.df.withColumnRenamed(column, check_name(new_name)))


def drop_attribute(table: RecordTable, column: str) -> RecordTable:
    _changeable(table, column)
    if column in table.edge_tables:
        rest = {k: v for k, v in table.edge_tables.items() if k != column}
        return RecordTable(table.name, table.df, table.primary_key, rest)
    return table.with_df(table.df.drop(column))


def drop_type(collection: Collection, name: str) -> Collection:
    """The collection without a type; its edge tables go with it."""
    table = collection[name]
    others = [r for r in referrers(collection, name) if r[0] != table.name]
    if others:
        raise Conflict(f"{name} is referred to by {others[0][0]}.{others[0][1]}")
    return Collection({n: t for n, t in collection.tables.items() if n != name})


# ---- descriptions as data --------------------------------------------------


def _rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def describe_type(table: RecordTable) -> DataFrame:
    """A row per attribute, key first: its type, relation target and the record count."""
    targets = table.relations
    described = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("attribute"),
            F.lit(table.types[name].value).alias("attribute_type"),
            F.lit(targets.get(name)).cast("string").alias("relation_target"),
        )
        for i, name in enumerate(table.attributes)
    ]
    counted = table.df.agg(F.count(F.lit(1)).alias("record_count"))
    return counted.select(
        F.lit(table.name).alias("record_type"),
        F.lit(table.primary_key).alias("primary_key"),
        "record_count",
        F.inline(F.array(*described)),
    )


def describe_types(collection: Collection) -> DataFrame:
    described = None
    for name in collection.record_types():
        one = describe_type(collection[name])
        described = one if described is None else described.unionByName(one)
    return described


def list_types(collection: Collection, spark: SparkSession) -> DataFrame:
    return _rows(spark, [(n,) for n in collection.record_types()], "record_type string")


def list_relations(collection: Collection, spark: SparkSession) -> DataFrame:
    """A row per relation attribute, scalar and array."""
    rows = [
        (t.name, relation, target, t.type(relation).is_array)
        for t in collection.tables.values()
        for relation, target in sorted(t.relations.items())
    ]
    return _rows(spark, rows, "record_type string, relation string, target string, is_array boolean")


def visible_types(catalog: DataFrame) -> DataFrame:
    """Rows of a ``record_type`` catalog whose names are not reserved."""
    return catalog.filter(~F.col("record_type").startswith(RESERVED_PREFIX))
