"""Conversion of a column from one attribute type to another.

A value that cannot be converted fails the whole job, so that a conversion
either holds for every record or changes none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.errors import UnsupportedConversion
from recordloom.functions.jsontext import number_text
from recordloom.model import AttributeType as A

_SCALARS = (A.NUMBER, A.BOOLEAN, A.DATE, A.DATE_TIME)
_PAIRS = {
    *(frozenset({A.STRING, other}) for other in _SCALARS),
    *(frozenset({A.NUMBER, other}) for other in _SCALARS if other is not A.NUMBER),
    frozenset({A.DATE, A.DATE_TIME}),
}

# The spellings text may use for a boolean, prefixes included.
TRUE_SPELLINGS = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
FALSE_SPELLINGS = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")


def is_supported(source: A, target: A) -> bool:
    if source.is_array and not target.is_array:
        return False
    return source.base is target.base or frozenset({source.base, target.base}) in _PAIRS


def convert(c: Column, source: A, target: A) -> Column:
    """``c`` of type ``source`` as ``target``."""
    if not is_supported(source, target):
        raise UnsupportedConversion(f"cannot convert {source.value} to {target.value}")
    if source.is_array:
        return F.transform(c, lambda e: convert_scalar(e, source.base, target.base))
    scalar = convert_scalar(c, source, target.base)
    return F.array(scalar) if target.is_array else scalar


def convert_scalar(c: Column, source: A, target: A) -> Column:
    if source is target:
        return c
    return {
        (A.STRING, A.NUMBER): lambda: _strict(c, F.when(_is_exact(c), c.try_cast("decimal(38,18)")), target),
        (A.STRING, A.BOOLEAN): lambda: _strict(c, _spelled_boolean(c), target),
        (A.STRING, A.DATE): lambda: _strict(c, c.try_cast("date"), target),
        (A.STRING, A.DATE_TIME): lambda: _strict(c, c.try_cast("timestamp_ntz"), target),
        (A.NUMBER, A.STRING): lambda: number_text(c),
        (A.NUMBER, A.BOOLEAN): lambda: F.round(c.cast("decimal(38,18)"), 0) != 0,
        (A.NUMBER, A.DATE_TIME): lambda: _from_epoch(c),
        (A.NUMBER, A.DATE): lambda: _from_epoch(c).cast("date"),
        (A.BOOLEAN, A.NUMBER): lambda: c.cast("int").cast("decimal(38,18)"),
        (A.BOOLEAN, A.STRING): lambda: c.cast("string"),
        (A.DATE, A.NUMBER): lambda: (F.unix_date(c).cast("bigint") * 86400).cast("decimal(38,18)"),
        (A.DATE, A.DATE_TIME): lambda: c.cast("timestamp_ntz"),
        (A.DATE, A.STRING): lambda: c.cast("string"),
        (A.DATE_TIME, A.NUMBER): lambda: _to_epoch(c),
        (A.DATE_TIME, A.DATE): lambda: c.cast("date"),
        # a date-time's text names its zone, which is always UTC
        (A.DATE_TIME, A.STRING): lambda: F.concat(c.cast("string"), F.lit("+00")),
    }[source, target]()


def _strict(original: Column, converted: Column, target: A) -> Column:
    """``converted``, which is computed once; an error where only it is null."""
    message = F.concat(F.lit("not a "), F.lit(target.value), F.lit(": "), original)
    return F.coalesce(converted, F.when(original.isNotNull(), F.raise_error(message)))


def _is_exact(c: Column) -> Column:
    """Whether a number's text has no digits beyond the 18 places that are kept: it is refused rather than rounded.

    A short text without an exponent can't have more, which is told without a regular expression.
    """
    short = (F.length(c) <= 19) & ~c.contains("e") & ~c.contains("E")
    fraction = F.rtrim(F.regexp_extract(c, r"\.([0-9]*)", 1), F.lit("0"))
    exponent = F.coalesce(F.regexp_extract(c, r"[eE]([+-]?[0-9]{1,4})", 1).try_cast("int"), F.lit(0))
    return short | (F.length(fraction) - exponent <= 18)


def _spelled_boolean(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(*TRUE_SPELLINGS), True).when(text.isin(*FALSE_SPELLINGS), False)


def _from_epoch(c: Column) -> Column:
    micros = F.round(c.cast("decimal(38,18)").cast("decimal(26,8)") * 1_000_000, 0)
    return F.timestamp_micros(micros.cast("bigint")).cast("timestamp_ntz")


def _to_epoch(c: Column) -> Column:
    micros = F.unix_micros(c.cast("timestamp")).cast("decimal(20,0)")
    return (micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,6)")
