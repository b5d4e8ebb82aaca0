"""Recognisers: does this text spell a value of some type?

Each exists as a rule over SQL text (``*_rule``), for use inside larger rules, and
as a function of a column name or column. They are null only where the text is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.sqltext import apply, literal

# The accepted spellings, as patterns.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE_PATTERN = r"^(\d{4}|-\d{4}|[+-]\d{5,7})-\d{2}-\d{2}$"
DATE_TIME_PATTERN = (
    r"^(\d{4}|-\d{4}|[+-]\d{5,7})-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?$"
)
UUID_PATTERN = r"^[0-9a-fA-F]{1,8}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,12}$"
_LABEL = r"[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?"
_HOST = rf"({_LABEL}|({_LABEL}\.)+[a-zA-Z]([a-zA-Z0-9-]*[a-zA-Z0-9])?\.?|\d+(\.\d+){{3}})"
_TAIL = r'(:\d*)?([/?#][^\s"<>\\^`{|}]*)?$'
DRS_PATTERN = rf"^(?i:drs)://([^\s/?#@]*@)?{_HOST}{_TAIL}"
BLOB_PATTERN = (
    rf"^(?i:https)://([^\s/?#@]*@)?({_LABEL}\.)+(?i:blob\.core\.windows\.net){_TAIL}"
)


def boolean_rule(x: str) -> str:
    return f"lower({x}) IN ('true', 'false')"


def number_rule(x: str) -> str:
    return f"{x} RLIKE {literal(NUMBER_PATTERN)}"


def date_rule(x: str) -> str:
    return f"({x} RLIKE {literal(DATE_PATTERN)} AND try_cast({x} AS DATE) IS NOT NULL)"


def date_time_value_rule(x: str) -> str:
    return f"try_cast(translate({x}, 't', 'T') AS TIMESTAMP_NTZ)"


def date_time_rule(x: str) -> str:
    return f"({x} RLIKE {literal(DATE_TIME_PATTERN)} AND {date_time_value_rule(x)} IS NOT NULL)"


def json_object_rule(x: str) -> str:
    # the prefix test spares the parser for the many cells that cannot be objects
    return f"(startswith(ltrim({x}), '{{') AND try_parse_json({x}) IS NOT NULL)"


def file_rule(x: str) -> str:
    return f"({x} RLIKE {literal(DRS_PATTERN)} OR {x} RLIKE {literal(BLOB_PATTERN)})"


def straighten_rule(x: str) -> str:
    """Curly double quotes, as office programs write them, to straight ones."""
    return f"translate({x}, '“”', '\"\"')"


def is_boolean(c: str | Column) -> Column:
    return apply(boolean_rule, c)


def is_number(c: str | Column) -> Column:
    return apply(number_rule, c)


def is_date(c: str | Column) -> Column:
    """Strict ISO date that exists in the calendar."""
    return apply(date_rule, c)


def is_date_time(c: str | Column) -> Column:
    """Strict ISO local date-time, seconds and fraction optional."""
    return apply(date_time_rule, c)


def date_time(c: str | Column) -> Column:
    """Local date-time of ISO text, null where the text is none."""
    return apply(date_time_value_rule, c)


def is_json_object(c: str | Column) -> Column:
    return apply(json_object_rule, c)


def is_file(c: str | Column) -> Column:
    return apply(file_rule, c)


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID_PATTERN)


def straighten_quotes(c: Column) -> Column:
    return F.translate(c, "“”", '""')
