"""Attribute type of single cells, as names of ``AttributeType``.

Scalars are tried from the most to the least specific type. Arrays take the type
their element types agree on.
"""

from __future__ import annotations

from pyspark.sql import Column

from recordloom.constants import RELATION_SCHEME
from recordloom.functions import recognise as R
from recordloom.functions.sqltext import apply, let, literal

_BOOLEAN_LIST = literal(r"^\s*\[\s*(?i:true|false)(\s*,\s*(?i:true|false))*\s*\]")


def text_rule(x: str) -> str:
    return f"""CASE
        WHEN {x} IS NULL THEN 'NULL'
        WHEN startswith({x}, {literal(RELATION_SCHEME)}) THEN 'RELATION'
        WHEN {R.date_rule(x)} THEN 'DATE'
        WHEN {R.date_time_rule(x)} THEN 'DATE_TIME'
        WHEN {R.boolean_rule(x)} THEN 'BOOLEAN'
        WHEN {R.json_object_rule(x)} THEN 'JSON'
        WHEN {R.file_rule(x)} THEN 'FILE'
        ELSE 'STRING' END"""


def _shape_rule(value: str, shape: str, array: str, obj: str) -> str:
    """Type of a variant of known shape; for arrays and objects as given."""
    text = let(f"variant_get({value}, '$', 'string')", "txt", text_rule("txt"))
    return f"""CASE
        WHEN {value} IS NULL OR {shape} = 'VOID' THEN 'NULL'
        WHEN {shape} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({shape}, 'DECIMAL') THEN 'NUMBER'
        WHEN {shape} = 'BOOLEAN' THEN 'BOOLEAN'
        WHEN startswith({shape}, 'ARRAY') THEN {array}
        WHEN startswith({shape}, 'OBJECT') THEN {obj}
        ELSE {text} END"""


def element_rule(v: str) -> str:
    """Type of one variant array element; ``NESTED`` for arrays and objects."""
    shaped = _shape_rule(v, "elem_shape", "'NESTED'", "'NESTED'")
    return let(f"schema_of_variant({v})", "elem_shape", shaped)


def agreed_array_rule(types: str) -> str:
    """Array type for the element type names, given in element order.

    Nulls yield to any type. Dates followed by date-times widen to date-times;
    any other mixture is an array of strings. Nested elements make it JSON.
    """
    decided = f"""CASE
        WHEN size({types}) = 0 THEN 'EMPTY_ARRAY'
        WHEN array_contains({types}, 'NESTED') THEN 'ARRAY_OF_JSON'
        WHEN size(kinds) = 0 THEN 'ARRAY_OF_STRING'
        WHEN size(kinds) = 1 THEN concat('ARRAY_OF_', get(kinds, 0))
        WHEN kinds = array('DATE', 'DATE_TIME') THEN 'ARRAY_OF_DATE_TIME'
        ELSE 'ARRAY_OF_STRING' END"""
    return let(f"array_remove(array_distinct({types}), 'NULL')", "kinds", decided)


def array_rule(v: str) -> str:
    elements = f"transform(variant_get({v}, '$', 'array<variant>'), elem -> {element_rule('elem')})"
    return let(elements, "elem_types", agreed_array_rule("elem_types"))


def json_rule(v: str) -> str:
    shaped = _shape_rule("val", "shape", array_rule("val"), "'JSON'")
    return let(v, "val", let("schema_of_variant(val)", "shape", shaped))


def tsv_array_rule(x: str) -> str:
    """Variant array held by a TSV cell, null where the cell holds none.

    Booleans may be in any case, if the list holds nothing else.
    """
    text = R.straighten_rule(x)
    cased = f"CASE WHEN {x} RLIKE {_BOOLEAN_LIST} THEN lower({x}) ELSE {text} END"
    return f"CASE WHEN startswith(ltrim({x}), '[') THEN try_parse_json({cased}) END"


def tsv_rule(x: str) -> str:
    quoted = let(f"substr({x}, 2, length({x}) - 2)", "inside", text_rule("inside"))
    listed = let(
        tsv_array_rule(x),
        "arr",
        f"CASE WHEN arr IS NOT NULL THEN {array_rule('arr')} ELSE 'STRING' END",
    )
    return f"""CASE
        WHEN {x} IS NULL OR {x} = '' THEN 'NULL'
        WHEN {quoted_rule(x)} THEN {quoted}
        WHEN {R.boolean_rule(x)} THEN 'BOOLEAN'
        WHEN {R.number_rule(x)} THEN 'NUMBER'
        WHEN {R.json_object_rule(x)} THEN 'JSON'
        WHEN startswith(ltrim({x}), '[') THEN {listed}
        ELSE {text_rule(x)} END"""


def quoted_rule(x: str) -> str:
    return f"""(startswith({x}, '"') AND endswith({x}, '"') AND length({x}) >= 2)"""


def text_type(c: str | Column) -> Column:
    """Type of a value known to be text: a JSON string or a quoted cell."""
    return apply(text_rule, c)


def array_type(c: str | Column) -> Column:
    """Type of a variant that holds an array."""
    return apply(array_rule, c)


def json_type(c: str | Column) -> Column:
    """Type of a value that came as JSON, given as a variant."""
    return apply(json_rule, c)


def tsv_type(c: str | Column) -> Column:
    """Type of a TSV cell."""
    return apply(tsv_rule, c)


def tsv_array(c: str | Column) -> Column:
    return apply(tsv_array_rule, c)


def is_quoted(c: str | Column) -> Column:
    return apply(quoted_rule, c)
