"""Exports: TSV, entity operations, renamed attributes, write counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.constants import EXPORT_PREFIX_MANIFEST, EXPORT_PREFIX_NESTED
from recordloom.functions.jsontext import date_time_text, number_text, string_json, value_json
from recordloom.functions.relation import relation_uri
from recordloom.model import AttributeType as A
from recordloom.model import RecordTable, quoted
from recordloom.operators.traverse import bare_id

# ---- TSV -------------------------------------------------------------------


def tsv_cells(table: RecordTable) -> DataFrame:
    """All attributes as cell text, key first; null is the empty cell."""
    columns = []
    for name in [n for n in table.attributes if n in table.df.columns]:
        kind, c = table.type(name), quoted(name)
        if kind is A.RELATION:
            c = F.when(c.isNotNull(), relation_uri(table.relations[name], bare_id(c)))
        if kind.is_array or kind is A.JSON:
            c = value_json(c, kind)
        elif kind is A.NUMBER:
            c = number_text(c)
        elif kind is A.DATE_TIME:
            c = date_time_text(c)
        columns.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return table.df.select(*columns)


def write_tsv(table: RecordTable, path: str) -> None:
    """Files in primary key order, each with the header."""
    ordered = tsv_cells(table).orderBy(quoted(table.primary_key))
    ordered.write.mode("overwrite").csv(
        path, sep="\t", header=True, quote='"', escape='"', emptyValue=""
    )


# ---- attribute names -------------------------------------------------------


def export_name(attribute: str, record_type: str, prefix: str | None) -> str:
    """Name of an attribute in an export; one that has a prefix keeps it."""
    if ":" in attribute or prefix is None:
        return attribute
    if prefix == EXPORT_PREFIX_NESTED:
        return f"{prefix}:{record_type}_name" if attribute == "name" else f"{prefix}:{attribute}"
    if prefix == EXPORT_PREFIX_MANIFEST and attribute in ("name", "entityType", f"{record_type}_id"):
        return f"{prefix}:{attribute}"
    return attribute


def prefixed(table: RecordTable, prefix: str | None) -> DataFrame:
    """Records with export names; the key is no attribute and keeps its own."""
    names = {
        n: export_name(n, table.name, prefix) for n in table.df.columns if n != table.primary_key
    }
    return table.df.withColumnsRenamed({k: v for k, v in names.items() if k != v})


# ---- entity operations -----------------------------------------------------


def _operation(op: str, name_field: str, name: str, value_field=None, value: Column | None = None) -> Column:
    """JSON text of one operation; null where its value is."""
    head = F.concat(F.lit(f'{{"op":"{op}","{name_field}":'), string_json(F.lit(name)))
    if value_field is None:
        return F.concat(head, F.lit("}"))
    return F.concat(head, F.lit(f',"{value_field}":'), value, F.lit("}"))


def _reference(target: str, c: Column) -> Column:
    kind = string_json(F.lit(target))
    return F.concat(
        F.lit('{"entityType":'), kind, F.lit(',"entityName":'), string_json(bare_id(c)), F.lit("}")
    )


def _operations(table: RecordTable, name: str, prefix: str | None) -> Column:
    """Array of the operations that set one attribute; empty where it is null."""
    kind, c = table.type(name), quoted(name)
    shown = export_name(name, table.name, prefix)

    def text(value: Column) -> Column:
        if kind.base is A.RELATION:
            return _reference(table.relations[name], value)
        return value_json(value, kind.base)

    none = F.array().cast("array<string>")
    if not kind.is_array:
        one = _operation("AddUpdateAttribute", "attributeName", shown, "addUpdateAttribute", text(c))
        return F.when(c.isNotNull(), F.array(one)).otherwise(none)
    if kind is A.ARRAY_OF_RELATION:
        create = _operation("CreateAttributeEntityReferenceList", "attributeListName", shown)
        # an empty list shows no reference, so it is made as a list of values
        values = _operation("CreateAttributeValueList", "attributeName", shown)
        create = F.when(F.size(c) > 0, create).otherwise(values)
    else:
        create = _operation("CreateAttributeValueList", "attributeName", shown)
    add = F.transform(
        c,
        lambda e: _operation(
            "AddListMember", "attributeListName", shown, "newMember", F.coalesce(text(e), F.lit("null"))
        ),
    )
    listed = F.concat(F.array(_operation("RemoveAttribute", "attributeName", shown), create), add)
    return F.when(c.isNotNull(), listed).otherwise(none)


def entity_operations(table: RecordTable, prefix: str | None = None) -> DataFrame:
    """A row ``(name, entityType, operations)`` per record.

    ``operations`` is JSON text: an array of the operations that set the record's
    attributes, in name order. Nulls set nothing. It is a projection: each record
    is turned over where it is read.
    """
    names = [n for n in table.attributes if n != table.primary_key and n in table.df.columns]
    parts = [_operations(table, n, prefix) for n in names]
    every = F.concat(*parts) if parts else F.array().cast("array<string>")
    return table.df.select(
        quoted(table.primary_key).alias("name"),
        F.lit(table.name).alias("entityType"),
        F.concat(F.lit("["), F.array_join(every, ","), F.lit("]")).alias("operations"),
    )


def write_entity_operations(table: RecordTable, path: str, prefix: str | None = None) -> None:
    """One JSON entity per line."""
    rows = entity_operations(table, prefix)
    line = F.concat(
        F.lit('{"name":'), string_json(F.col("name")),
        F.lit(',"entityType":'), string_json(F.col("entityType")),
        F.lit(',"operations":'), F.col("operations"), F.lit("}"),
    )
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


# ---- counts ----------------------------------------------------------------


def write_counts(passes: Sequence[DataFrame], column: str = "type") -> DataFrame:
    """Records written per type, added up over all passes of an import."""
    counts = None
    for rows in passes:
        one = rows.groupBy(F.col(column).alias("record_type")).agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy("record_type").agg(F.sum("n").alias("written"))
