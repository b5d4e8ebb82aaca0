"""Rules written once as SQL text and applied to columns.

A rule is a function from the SQL text of its operand to the SQL text of its
result. Long rules are cheap to build this way: the whole expression crosses to
the JVM as one string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[str], str]


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(text: str) -> str:
    if "'" in text:
        raise ValueError("a raw literal cannot hold a single quote")
    return f"r'{text}'"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {variable} -> {body}), 0)"


def apply(rule: Rule, operand: str | Column) -> Column:
    """The rule's value for a column name (fully compiled) or any expression."""
    if isinstance(operand, str):
        return F.expr(rule(name(operand)))
    body = F.expr(f"operand -> {rule('operand')}")
    return F.get(F.call_function("transform", F.array(operand), body), 0)
