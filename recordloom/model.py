"""Attribute types, record tables and collections.

A record table is a DataFrame plus what Spark types cannot say: which column is
the primary key, which text columns are relations or files, and which record
type a relation points at. That knowledge is kept in the column metadata, so it
survives projections and is stored in Parquet footers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.constants import DEFAULT_PRIMARY_KEY, NAME_PATTERN, RESERVED_PREFIX
from recordloom.errors import InvalidName, MissingObject

META_TYPE = "attribute_type"
META_TARGET = "relation_target"
META_KEY = "primary_key"

ARRAY_PREFIX = "ARRAY_OF_"


class AttributeType(str, Enum):
    NULL = "NULL"
    EMPTY_ARRAY = "EMPTY_ARRAY"
    BOOLEAN = "BOOLEAN"
    DATE = "DATE"
    DATE_TIME = "DATE_TIME"
    STRING = "STRING"
    RELATION = "RELATION"
    JSON = "JSON"
    NUMBER = "NUMBER"
    FILE = "FILE"
    ARRAY_OF_BOOLEAN = "ARRAY_OF_BOOLEAN"
    ARRAY_OF_DATE = "ARRAY_OF_DATE"
    ARRAY_OF_DATE_TIME = "ARRAY_OF_DATE_TIME"
    ARRAY_OF_STRING = "ARRAY_OF_STRING"
    ARRAY_OF_RELATION = "ARRAY_OF_RELATION"
    ARRAY_OF_JSON = "ARRAY_OF_JSON"
    ARRAY_OF_NUMBER = "ARRAY_OF_NUMBER"
    ARRAY_OF_FILE = "ARRAY_OF_FILE"

    @property
    def is_array(self) -> bool:
        return self is AttributeType.EMPTY_ARRAY or self.value.startswith(ARRAY_PREFIX)

    @property
    def base(self) -> AttributeType:
        if self is AttributeType.EMPTY_ARRAY:
            return AttributeType.NULL
        return AttributeType(self.value.removeprefix(ARRAY_PREFIX))

    @property
    def array(self) -> AttributeType:
        """The array type with this base; an array of nulls only is one of strings."""
        base = AttributeType.STRING if self is AttributeType.NULL else self.base
        return AttributeType(ARRAY_PREFIX + base.value)

    @property
    def stored(self) -> AttributeType:
        """What the type reads back as: the two inference-only types are text."""
        if self is AttributeType.NULL:
            return AttributeType.STRING
        if self is AttributeType.EMPTY_ARRAY:
            return AttributeType.ARRAY_OF_STRING
        return self

    @property
    def spark_type(self) -> T.DataType:
        if self.is_array:
            return T.ArrayType(self.base.spark_type)
        return {
            AttributeType.BOOLEAN: T.BooleanType(),
            AttributeType.DATE: T.DateType(),
            AttributeType.DATE_TIME: T.TimestampNTZType(),
            AttributeType.NUMBER: T.DecimalType(38, 18),
        }.get(self, T.StringType())


def type_of(field_: T.StructField) -> AttributeType:
    """Attribute type of a column: its tag if it has one, else its Spark type."""
    if field_.metadata and META_TYPE in field_.metadata:
        return AttributeType(field_.metadata[META_TYPE])
    return _from_spark(field_.dataType)


def _from_spark(data_type: T.DataType) -> AttributeType:
    if isinstance(data_type, T.ArrayType):
        return _from_spark(data_type.elementType).array
    if isinstance(data_type, T.BooleanType):
        return AttributeType.BOOLEAN
    if isinstance(data_type, T.NumericType):
        return AttributeType.NUMBER
    if isinstance(data_type, T.DateType):
        return AttributeType.DATE
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType)):
        return AttributeType.DATE_TIME
    if isinstance(data_type, (T.StructType, T.MapType, T.VariantType)):
        return AttributeType.JSON
    return AttributeType.STRING


def tag(
    df: DataFrame,
    primary_key: str | None = None,
    types: Mapping[str, AttributeType] | None = None,
    relations: Mapping[str, str] | None = None,
) -> DataFrame:
    """Record key, types and relation targets in the column metadata of ``df``."""
    types = dict(types or {})
    for name in relations or {}:
        is_array = isinstance(df.schema[name].dataType, T.ArrayType)
        types[name] = AttributeType.ARRAY_OF_RELATION if is_array else AttributeType.RELATION
    columns = []
    for f in df.schema.fields:
        meta = dict(f.metadata or {})
        if f.name in types:
            meta[META_TYPE] = types[f.name].value
        if f.name in (relations or {}):
            meta[META_TARGET] = relations[f.name]
        if f.name == primary_key:
            meta[META_KEY] = True
        column = quoted(f.name)
        columns.append(column.alias(f.name, metadata=meta) if meta else column)
    return df.select(*columns)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_name(name: str) -> str:
    if not re.match(NAME_PATTERN, name) or name.startswith(RESERVED_PREFIX):
        raise InvalidName(f"name {name!r} is not allowed")
    return name


@dataclass(frozen=True)
class NativeKey:
    """The rows of a table before their whole-number key became text, and what made records of them.

    An id that is the usual text of a whole number selects here, by the number: such a filter reaches the files, which
    know their least and greatest keys. Any other id is no record's.
    """

    rows: DataFrame
    column: str
    project: Callable[[DataFrame], DataFrame]

    @property
    def _range(self) -> range:
        bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(self.rows.schema[self.column].dataType.simpleString(), 63)
        return range(-(1 << bits), 1 << bits)

    def among(self, ids: Sequence[str]) -> DataFrame:
        """The records with one of the ids."""
        found = {int(i) for i in ids if re.fullmatch("0|-?[1-9][0-9]{0,18}", i, re.ASCII)}
        numbers = sorted(n for n in found if n in self._range)
        return self.project(self.rows.where(quoted(self.column).isin(*numbers) if numbers else F.lit(False)))

    def joined(self, ids: DataFrame) -> DataFrame:
        """The records with an id in ``ids.record_id``."""
        number = F.col("record_id").try_cast("bigint")
        asked = ids.where(number.cast("string") == F.col("record_id")).select(number.alias("sys_asked"))
        return self.project(self.rows.join(asked, quoted(self.column) == F.col("sys_asked"), "left_semi"))


@dataclass(frozen=True)
class RecordTable:
    """One record type: its rows, and edge rows for relations not held in a column.

    ``native`` is the key as it is stored, if that is not text; a table with other rows (``with_df``) has none.
    """

    name: str
    df: DataFrame
    primary_key: str = DEFAULT_PRIMARY_KEY
    # relation attribute -> (target type, DataFrame(from_id, to_id))
    edge_tables: Mapping[str, tuple[str, DataFrame]] = field(default_factory=dict)
    native: NativeKey | None = None

    @classmethod
    def of(cls, name: str, df: DataFrame, **kw) -> RecordTable:
        """Build a table whose key is the column tagged as such."""
        keys = [f.name for f in df.schema.fields if (f.metadata or {}).get(META_KEY)]
        return cls(name, df, keys[0] if keys else DEFAULT_PRIMARY_KEY, **kw)

    def with_df(self, df: DataFrame) -> RecordTable:
        return RecordTable(self.name, df, self.primary_key, self.edge_tables)

    @property
    def types(self) -> dict[str, AttributeType]:
        found = {f.name: type_of(f) for f in self.df.schema.fields}
        for name in self.edge_tables:
            found.setdefault(name, AttributeType.ARRAY_OF_RELATION)
        return found

    def type(self, column: str) -> AttributeType:
        try:
            return self.types[column]
        except KeyError:
            raise MissingObject(f"{self.name} has no attribute {column!r}") from None

    @property
    def relations(self) -> dict[str, str]:
        """Relation attributes, scalar and array, with their target types."""
        found = {
            f.name: f.metadata[META_TARGET]
            for f in self.df.schema.fields
            if f.metadata and META_TARGET in f.metadata
        }
        found.update({name: target for name, (target, _) in self.edge_tables.items()})
        return found

    @property
    def attributes(self) -> list[str]:
        """Primary key first, the rest in binary name order."""
        rest = sorted(n for n in self.types if n != self.primary_key)
        return [self.primary_key, *rest]


@dataclass(frozen=True)
class Collection:
    """Record tables that may relate to each other."""

    tables: Mapping[str, RecordTable]

    @classmethod
    def of(cls, *tables: RecordTable) -> Collection:
        return cls({t.name: t for t in tables})

    def __getitem__(self, name: str) -> RecordTable:
        try:
            return self.tables[name]
        except KeyError:
            raise MissingObject(f"no record type {name!r}") from None

    def replace(self, table: RecordTable) -> Collection:
        return Collection({**self.tables, table.name: table})

    def record_types(self) -> list[str]:
        return sorted(n for n in self.tables if not n.startswith(RESERVED_PREFIX))
