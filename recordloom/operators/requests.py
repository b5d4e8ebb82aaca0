"""Requests as rows, each refused with a reason or let through.

What ``search.term`` and ``ingest.merge_records`` check of one request while a plan is built is checked here of any number
of requests at once, by expressions over the schema: nothing of the records is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable

#: What a value must be in the text of a term, by the type it is compared with.
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?$"
_NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _wrong_value(kind: A, value: Column) -> Column | None:
    """Why text can't be compared with values of a type, or null; None for types that any text can be."""
    if kind is A.NUMBER:
        return F.when(~value.rlike(_NUMBER), "is not a number")
    if kind is A.BOOLEAN:
        return F.when(~F.lower(value).isin("true", "false"), "is neither true nor false")
    if kind is A.DATE:
        return F.when(~value.rlike(_DATE) | value.try_cast("date").isNull(), "is not an ISO date")
    if kind is A.DATE_TIME:
        return F.when(~value.rlike(_DATE_TIME) | value.try_cast("timestamp_ntz").isNull(), "is not an ISO date-time")
    if kind is A.JSON:
        return F.when(F.try_parse_json(value).isNull(), "is not JSON")
    return None


def term_problems(table: RecordTable, requests: DataFrame) -> DataFrame:
    """``request_id``, ``column`` and ``problem`` of the terms that a table can't answer.

    ``requests`` has request_id, column and value, all the term is. A term needs a column that the table has and a value
    that its type, or its members' type, can be compared with. No row says that a term is fine.
    """
    column, value = F.col("column"), F.col("value")
    problem = F.when(F.coalesce(column, F.lit("")) == "", "names no attribute").when(~column.isin(*table.types), "names an attribute that is not there")
    problem = problem.when(value.isNull(), "has no value")
    for base in A:
        reason = None if base.is_array else _wrong_value(base, value)
        names = [n for n, kind in table.types.items() if kind.base is base]
        if reason is not None and names:
            problem = problem.when(column.isin(*names), reason)
    return requests.select("request_id", "column", problem.alias("problem")).where("problem is not null")


def key_problems(collection: Collection, uploads: DataFrame, record_types: list[str]) -> DataFrame:
    """``upload_id``, ``record_type`` and ``problem`` of uploads that name another primary key than their type has.

    ``uploads`` has upload_id, record_type and primary_key; of ``record_types`` the collection has tables, any other type
    is new and takes the key that it is given, and so does one that names none.
    """
    pairs = [F.lit(x) for t in record_types for x in (t, collection[t].primary_key)]
    known = F.try_element_at(F.create_map(*pairs), F.col("record_type")) if pairs else F.lit(None).cast("string")
    problem = F.when(F.col("primary_key") != known, F.concat(F.lit("the primary key is "), known, F.lit(", not "), F.col("primary_key")))
    return uploads.select("upload_id", "record_type", problem.alias("problem")).where("problem is not null")
