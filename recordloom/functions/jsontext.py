"""JSON text of typed columns, and the canonical form used to compare JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.model import AttributeType

def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and plain numbers, so equal values are equal text."""
    return F.to_json(F.parse_json(c))


def _without_trailing_zeros(text: Column) -> Column:
    """Text of a number that has a decimal point, at its shortest."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def number_text(c: Column) -> Column:
    """A number without the zeros that a fixed scale adds; a double too small or large for that, as Spark prints it."""
    exact = c.try_cast("decimal(38,18)")
    held = exact.isNotNull() & (exact.cast("double") == c.cast("double"))
    return F.when(held, _without_trailing_zeros(exact.cast("string"))).otherwise(c.cast("string"))


def date_time_text(c: Column) -> Column:
    """ISO text of a date-time; a fraction only where there is one."""
    return _without_trailing_zeros(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def string_json(c: Column) -> Column:
    """A quoted and escaped JSON string."""
    # the only brackets outside the quotes are those of the array
    return F.when(c.isNotNull(), F.trim(F.to_json(F.array(c)), F.lit("[]")))


def value_json(c: Column, kind: AttributeType) -> Column:
    """JSON text of one typed value; null stays null."""
    if kind.is_array:
        parts = F.transform(c, lambda e: F.coalesce(value_json(e, kind.base), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    if kind is AttributeType.NUMBER:
        return number_text(c)
    if kind is AttributeType.BOOLEAN:
        return c.cast("string")
    if kind is AttributeType.DATE:
        return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    if kind is AttributeType.DATE_TIME:
        return F.concat(F.lit('"'), date_time_text(c), F.lit('"'))
    if kind is AttributeType.JSON:
        return c
    return string_json(c)
