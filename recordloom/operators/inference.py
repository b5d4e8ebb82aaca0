"""Column types and relation targets inferred from all rows of a table.

A column's type is that of folding its cells in arrival order: nulls yield, dates
followed by date-times widen, other mixtures become text. Since the outcome only
depends on which types occur, and on whether all dates come before all
date-times, one aggregation with a fixed-size buffer per column decides it; no
row order is imposed on the data and nothing is exploded.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.relation import relation_type
from recordloom.model import AttributeType as A
from recordloom.model import quoted

_BIT = {t.value: 1 << i for i, t in enumerate(A) if t is not A.NULL}
_ARRAYS = sum(_BIT[t.value] for t in A if t.is_array)


def select_best_type(existing: A, new: A) -> A:
    """Type of a column of ``existing`` values to which ``new`` ones arrive."""
    if existing is new or new is A.NULL:
        return existing
    if existing is A.NULL:
        return new
    if existing.is_array and new.is_array:
        if A.EMPTY_ARRAY in (existing, new):
            return existing if new is A.EMPTY_ARRAY else new
        widened = (existing, new) == (A.ARRAY_OF_DATE, A.ARRAY_OF_DATE_TIME)
        return A.ARRAY_OF_DATE_TIME if widened else A.ARRAY_OF_STRING
    return A.DATE_TIME if (existing, new) == (A.DATE, A.DATE_TIME) else A.STRING


#: The kinds whose order among each other counts, with what is kept of it: the last date and the first date-time.
_ORDERED = ((A.DATE, A.DATE_TIME, "last_date", "first_date_time"), (A.ARRAY_OF_DATE, A.ARRAY_OF_DATE_TIME, "last_dates", "first_date_times"))
PLACES = [n for _, _, last, first in _ORDERED for n in (last, first)]
#: What a column's cells come down to: which types occur, as bits, and places in the order of arrival.
BUFFERS = ["mask", *PLACES]


def _buffers(cell_type: Column, ordinal: Column) -> dict[str, Column]:
    """Aggregates over the cells of a column, by the names in ``BUFFERS``."""
    mask_of = F.create_map(*[F.lit(x) for pair in _BIT.items() for x in pair])
    mask = F.coalesce(F.bit_or(F.element_at(mask_of, F.nullif(cell_type, F.lit("NULL")))), F.lit(0))
    found = {"mask": mask}
    for date, stamp, last, first in _ORDERED:
        found[last] = F.max(F.when(cell_type == date.value, ordinal))
        found[first] = F.min(F.when(cell_type == stamp.value, ordinal))
    return found


def _decided(of: Mapping[str, Column]) -> Column:
    """The column type name that the buffers of a column come down to."""
    mask = of["mask"]
    only_arrays = mask.bitwiseAND(F.lit(~_ARRAYS)) == 0
    filled = mask.bitwiseAND(F.lit(~_BIT["EMPTY_ARRAY"]))
    result = F.when(mask == 0, "NULL")
    for kind in A:
        if kind is not A.NULL:
            result = result.when(mask == _BIT[kind.value], kind.value)
    for kind in A:
        if kind.is_array and kind is not A.EMPTY_ARRAY:
            result = result.when(only_arrays & (filled == _BIT[kind.value]), kind.value)
    for date, stamp, last, first in _ORDERED:
        where = filled if date.is_array else mask
        both = where == _BIT[date.value] + _BIT[stamp.value]
        result = result.when(both & (of[last] < of[first]), stamp.value)
    return result.when(only_arrays, "ARRAY_OF_STRING").otherwise("STRING")


def column_type_aggregate(cell_type: Column, ordinal: Column) -> Column:
    """Aggregate: the column type name for cell type names met in ``ordinal`` order."""
    return _decided(_buffers(cell_type, ordinal))


def infer_columns(df: DataFrame, cell_types: Mapping[str, Column], ordinal: Column) -> DataFrame:
    """One row ``(attribute, attribute_type)`` per column.

    ``cell_types`` gives, per attribute, the type name of its cell; ``ordinal``
    is the arrival order of the rows.
    """
    tmp = {name: f"t{i}" for i, name in enumerate(cell_types)}
    cells = df.select(
        ordinal.alias("ordinal"), *[c.alias(tmp[name]) for name, c in cell_types.items()]
    )
    wide = cells.agg(
        *[column_type_aggregate(F.col(t), F.col("ordinal")).alias(t) for t in tmp.values()]
    )
    pairs = [
        F.struct(F.lit(name).alias("attribute"), F.col(t).alias("attribute_type"))
        for name, t in tmp.items()
    ]
    return wide.select(F.inline(F.array(*pairs)))


def summarise_columns(df: DataFrame, cell_types: Mapping[str, Column], ordinal: Column, upload: int = 0) -> DataFrame:
    """What inference needs of a piece of a table, to be kept: one row ``(attribute, *BUFFERS)`` per column.

    Places have the number of the ``upload`` before the ordinal within it, so pieces of several uploads are in order too.
    """
    tmp = {name: f"t{i}" for i, name in enumerate(cell_types)}
    cells = df.select(ordinal.cast("long").alias("ordinal"), *[c.alias(tmp[name]) for name, c in cell_types.items()])
    aggregates = [a.alias(f"{t}_{n}") for t in tmp.values() for n, a in _buffers(F.col(t), F.col("ordinal")).items()]
    wide = cells.agg(*aggregates)

    def place(column: str) -> Column:
        both = F.struct(F.lit(upload).cast("int").alias("upload"), F.col(column).alias("ordinal"))
        return F.when(F.col(column).isNotNull(), both)

    rows = [
        F.struct(F.lit(name).alias("attribute"), F.col(f"{t}_mask").cast("long").alias("mask"), *[place(f"{t}_{n}").alias(n) for n in PLACES])
        for name, t in tmp.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def merge_summaries(*summaries: DataFrame) -> DataFrame:
    """The summary of all pieces together, whatever order they are merged in. A piece merged twice counts once."""
    every = summaries[0]
    for one in summaries[1:]:
        every = every.unionByName(one)
    ends = [(F.max if n.startswith("last") else F.min)(n).alias(n) for n in PLACES]
    return every.groupBy("attribute").agg(F.bit_or("mask").alias("mask"), *ends)


def column_types(summary: DataFrame) -> DataFrame:
    """``(attribute, attribute_type)`` of the columns that a summary describes."""
    return summary.select("attribute", _decided({n: F.col(n) for n in BUFFERS}).alias("attribute_type"))


def infer_schema(df: DataFrame, cell_types: Mapping[str, Column], ordinal: Column) -> dict[str, A]:
    """``infer_columns`` as a dictionary; one row per attribute reaches the driver."""
    rows = infer_columns(df, cell_types, ordinal).collect()
    return {r["attribute"]: A(r["attribute_type"]) for r in rows}


def relation_targets(df: DataFrame, columns: Mapping[str, A]) -> DataFrame:
    """Distinct ``(attribute, target)`` pairs over relation columns holding URIs.

    An array whose elements name several types contributes a null target, which
    no valid relation has.
    """
    targets = []
    for name, kind in columns.items():
        c = quoted(name)
        if kind.is_array:
            kinds = F.array_distinct(F.transform(c, relation_type))
            target = F.when(F.size(kinds) == 1, F.get(kinds, 0))
            given = F.size(c) > 0
        else:
            target, given = relation_type(c), c.isNotNull()
        targets.append(
            F.when(given, F.struct(F.lit(name).alias("attribute"), target.alias("target")))
        )
    pairs = df.select(F.explode(F.array_compact(F.array(*targets))).alias("pair"))
    return pairs.select("pair.*").distinct()
