"""Nested import rows ``(id, name, object, relations)`` holding many record types.

The rows come as Avro, where the session has that reader, or as Parquet or JSON
of the same shape; what happens to them is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.constants import IMPORT_METADATA_PREFIX, LIST_WRAPPER_NAMES, OPEN_CONSENT
from recordloom.errors import InvalidName
from recordloom.functions.jsontext import number_text
from recordloom.functions.recognise import is_uuid
from recordloom.functions.relation import relation_uri
from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable, check_name, quoted, tag
from recordloom.session import shared_dir

ID, TYPE, OBJECT, RELATIONS = "id", "name", "object", "relations"


def read_nested(spark: SparkSession, paths: str | Sequence[str], format: str = "avro") -> DataFrame:
    """Nested rows; ``format`` is ``avro``, ``parquet`` or ``json``."""
    return spark.read.format(format).load(paths)


def base_records(rows: DataFrame, record_type: str, convert_values: bool = True) -> DataFrame:
    """The base attributes of one record type, without its relations."""
    picked = rows.filter(quoted(TYPE) == record_type).select(ID, f"{OBJECT}.*")
    return convert_columns(picked) if convert_values else picked


def relation_records(rows: DataFrame, record_type: str, targets: Sequence[str]) -> DataFrame:
    """One relation column per target type, named after it; rows without any are left out.

    Of several relations to one type the last wins. It is picked inside the row's
    own array, so nothing is exploded or shuffled.
    """
    picked = rows.filter((quoted(TYPE) == record_type) & (F.size(RELATIONS) > 0))
    columns = []
    for target in targets:
        columns.append(_last_of(target).alias(target))
    found = picked.select(ID, *columns)
    given = F.coalesce(*[quoted(t) for t in targets]) if targets else F.lit(None)
    kept = found.filter(given.isNotNull())
    return tag(kept, ID, relations={t: t for t in targets})


def _last_of(target: str) -> Column:
    same = F.filter(RELATIONS, lambda r: r["dst_name"] == target)
    return F.get(same, F.size(same) - 1)["dst_id"]


def relation_uris(df: DataFrame, relations: Mapping[str, str]) -> DataFrame:
    """Columns holding keys, scalar or array, as relation URIs to their target types."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if f.name in relations:
            is_array = isinstance(f.dataType, T.ArrayType)
            c = _uris(c, relations[f.name], is_array).alias(f.name)
        out.append(c)
    return tag(df.select(*out), relations=relations)


def _uris(c: Column, target: str, is_array: bool) -> Column:
    def uri(key: Column) -> Column:
        return relation_uri(target, key.cast("string"))

    return F.transform(c, uri) if is_array else uri(c)


# ---- whole files -----------------------------------------------------------


def nested_summary(rows: DataFrame) -> DataFrame:
    """One row per record type: ``record_type``, ``records``, the ``targets`` of its relations and the fields ``given``.

    Types are counted and fields looked at where the rows are; a relation's target is one row per task.
    """
    fields = rows.schema[OBJECT].dataType.names
    given = F.array_compact(F.array(*[F.when(F.max(F.col(OBJECT).getField(f).isNotNull()), f) for f in fields]))
    counted = rows.groupBy(quoted(TYPE).alias("record_type")).agg(F.count(F.lit(1)).alias("records"), given.alias("given"))
    links = rows.select(quoted(TYPE).alias("linked"), F.explode(F.transform(RELATIONS, lambda r: r["dst_name"])).alias("target"))
    targets = links.where("target is not null").distinct().groupBy("linked").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    none = F.array().cast("array<string>")
    return counted.join(targets, F.col("record_type").eqNullSafe(F.col("linked")), "left").select(
        "record_type", "records", F.coalesce("targets", none).alias("targets"), "given"
    )


def load_nested(rows: DataFrame) -> tuple[Collection, dict[str, int]]:
    """All record types of nested rows as related record tables, and how many records each has.

    The rows are read once and dealt out by type to the shared folder; each table reads its own part. Its columns are the
    fields that any of its records gives, and a relation for each type that its records name; where that is the name of a
    field as well, the relation comes in its place. Base attributes and relations are those of ``base_records`` and
    ``relation_records``, in one projection. Rows without a type are an error.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/nested-{uuid.uuid4().hex}"
    rows.withColumn("sys_type", quoted(TYPE)).write.partitionBy("sys_type").parquet(path)
    # types are text, whatever their folders are called
    stored = spark.read.schema(rows.schema.add("sys_type", "string")).parquet(path)
    tables, counts = [], {}
    for r in nested_summary(stored).collect():
        name = r["record_type"]
        if name is None:
            raise InvalidName("some rows name no record type")
        check_name(name)
        part = stored.where(F.col("sys_type") == name)
        fields = [f for f in r["given"] if f not in r["targets"] and f != ID]
        links = [_last_of(t).alias(check_name(t)) for t in r["targets"]]
        picked = part.select(ID, *[F.col(OBJECT).getField(f).alias(f) for f in fields], *links)
        typed = convert_columns(picked, ids=[ID, *r["targets"]])
        tables.append(RecordTable(name, tag(typed, ID, relations={t: t for t in r["targets"]}), ID))
        counts[name] = r["records"]
    return Collection.of(*tables), counts


# ---- values ----------------------------------------------------------------


def convert_columns(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Every column as a value of the record model, by its Spark type.

    Columns in ``ids`` hold keys, scalar or array, and become text.
    """
    columns, types = [], {}
    for f in df.schema.fields:
        c, data_type = unwrap_list(quoted(f.name), f.dataType, f.name)
        if f.name in ids:
            is_array = isinstance(data_type, T.ArrayType)
            value, kind = c.cast("array<string>" if is_array else "string"), None
        else:
            value, kind = _value(c, data_type)
        columns.append(value.alias(f.name))
        if kind is not None:
            types[f.name] = kind
    return tag(df.select(*columns), types=types)


def unwrap_list(c: Column, data_type: T.DataType, name: str, wrapper: str | None = None):
    """``[{element: 1}, …]`` as ``[1, …]`` where the element records only wrap.

    Spark types do not name records, so the wrapper's name is given, or taken from
    its single field: ``list``, ``array``, ``element`` or ``<column>_tuple``.
    """
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType):
        fields = data_type.elementType.fields
        names = {*LIST_WRAPPER_NAMES, "element", f"{name}_tuple"}
        if len(fields) == 1 and (wrapper or fields[0].name) in names:
            inner = fields[0]
            return F.transform(c, lambda e: e[inner.name]), T.ArrayType(inner.dataType)
    return c, data_type


def _value(c: Column, t: T.DataType):
    """Converted column, and its attribute type where the Spark type does not say it."""
    if isinstance(t, T.ArrayType):
        kind = _value(F.lit(None), t.elementType)[1]
        return F.transform(c, lambda e: _value(e, t.elementType)[0]), kind.array if kind else None
    if isinstance(t, (T.StructType, T.MapType)):
        return F.to_json(c), A.JSON
    if isinstance(t, T.FloatType):
        # through text, so that 0.1 stays 0.1
        exact = c.cast("string").cast("double")
        return F.when(~F.isnan(c), exact), None
    if isinstance(t, T.DoubleType):
        return F.when(~F.isnan(c), c), None
    if isinstance(t, T.DecimalType):
        return number_text(c).cast("decimal(38,18)") if t.scale > 18 else c, None
    if isinstance(t, T.BinaryType):
        return byte_list(c), None
    if isinstance(t, T.TimestampType):
        return c.cast("timestamp_ntz"), None
    if isinstance(t, (T.BooleanType, T.NumericType, T.DateType, T.TimestampNTZType, T.StringType)):
        return c, None
    return c.cast("string"), None


def byte_list(c: Column) -> Column:
    """Bytes as text: their signed values in brackets."""
    hexed = F.hex(c)
    places = F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))
    unsigned = F.transform(
        places, lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("int")
    )
    signed = F.transform(unsigned, lambda b: F.when(b > 127, b - 256).otherwise(b))
    text = F.array_join(signed.cast("array<string>"), ", ")
    body = F.when(F.length(hexed) == 0, F.lit("")).otherwise(text)
    return F.concat(F.lit("["), body, F.lit("]"))


def date_value(c: Column) -> Column:
    """Days since the epoch as a date."""
    return F.date_from_unix_date(c.cast("int"))


def date_time_value(c: Column) -> Column:
    """Microseconds since the epoch as a date-time."""
    return F.timestamp_micros(c).cast("timestamp_ntz")


def time_value(c: Column) -> Column:
    """Microseconds of the day as ISO time text."""
    text = F.date_format(F.timestamp_micros(c), "HH:mm:ss.SSSSSS")
    whole = F.regexp_replace(text, r"\.000000$", "")
    return F.regexp_replace(whole, r"(\.\d{3})000$", "$1")


def with_import_metadata(df: DataFrame, snapshot_id: Column, imported_at: Column) -> DataFrame:
    """Records with where and when they were imported from."""
    stamp = F.date_format(imported_at, "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumns(
        {
            f"{IMPORT_METADATA_PREFIX}timestamp": stamp,
            f"{IMPORT_METADATA_PREFIX}snapshot_id": snapshot_id,
        }
    )


# ---- questions about whole files -------------------------------------------


def snapshot_ids(rows: DataFrame, field: str) -> DataFrame:
    """Distinct valid UUIDs in one field of the nested objects."""
    ids = rows.select(F.lower(F.col(OBJECT).getField(field).cast("string")).alias("snapshot_id"))
    return ids.filter(is_uuid(F.col("snapshot_id"))).distinct()


def consent_gate(rows: DataFrame, record_type: str, field: str, open_value: str = OPEN_CONSENT) -> DataFrame:
    """One row: is there a consent group, and are all of them the open one?"""
    groups = rows.filter(quoted(TYPE) == record_type).select(
        F.col(OBJECT).getField(field).alias("consent")
    )
    c = F.col("consent")
    if isinstance(groups.schema["consent"].dataType, T.ArrayType):
        given = F.size(c) > 0
        is_open = F.forall(F.array_compact(c), lambda e: e.cast("string") == open_value)
    else:
        given = c.cast("string") != ""
        is_open = c.cast("string") == open_value
    kept = groups.filter(c.isNotNull() & given)
    return kept.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.bool_and(is_open), F.lit(False)).alias("all_open"),
    )
