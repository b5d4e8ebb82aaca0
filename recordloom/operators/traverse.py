"""Following relations from record to record.

Every hop is an equi-join on a primary key. The key side holds each id once, so
a hot target (one customer with a third of all orders) multiplies no rows, and
adaptive execution splits its partition without changing the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME, ROOT_COLUMN
from recordloom.errors import InvalidRelation
from recordloom.functions.relation import relation_id
from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable, quoted

_NEXT = "sys_next"
ARRAY_ROOT = "sys_array_root"


def edges(table: RecordTable, relation: str) -> DataFrame:
    """Edge rows ``(from_id, to_id)`` of an array relation."""
    if relation in table.edge_tables:
        return table.edge_tables[relation][1]
    ids = F.explode(quoted(relation))
    pairs = table.df.select(quoted(table.primary_key).alias("from_id"), ids.alias("uri"))
    return pairs.select("from_id", bare_id(F.col("uri")).alias("to_id"))


def bare_id(c: Column) -> Column:
    """The id of a relation, which may be given as its URI."""
    return F.when(c.startswith(RELATION_SCHEME), relation_id(c)).otherwise(c)


def hop(collection: Collection, rows: DataFrame, table: RecordTable, relation: str, carry):
    """Replace the records in ``rows`` by those ``relation`` leads to.

    ``rows`` has the columns of ``table`` and the ``carry`` columns, which are
    kept. Returns the new rows and their table.
    """
    targets = table.relations
    if relation not in targets:
        raise InvalidRelation(f"{table.name} has no relation {relation!r}")
    target = collection[targets[relation]]
    kept = [F.col(c) for c in carry]
    if relation in table.edge_tables:
        edge = table.edge_tables[relation][1].select(
            F.col("from_id").alias("sys_from"), F.col("to_id").alias(_NEXT)
        )
        sources = rows.select(*kept, quoted(table.primary_key).alias("sys_key"))
        steps = sources.join(edge, F.col("sys_key") == F.col("sys_from")).select(*kept, _NEXT)
    elif table.type(relation) is A.ARRAY_OF_RELATION:
        exploded = rows.select(*kept, F.explode(quoted(relation)).alias("uri"))
        steps = exploded.select(*kept, bare_id(F.col("uri")).alias(_NEXT))
    else:
        steps = rows.select(*kept, bare_id(quoted(relation)).alias(_NEXT))
    joined = steps.join(target.df, F.col(_NEXT) == quoted(target.primary_key), "inner")
    return joined.drop(_NEXT), target


def follow(
    collection: Collection,
    root_type: str,
    path: Sequence[str],
    roots: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Records reached from each root along ``path``, keyed by ``sys_root``.

    Without ``roots`` it is done for every record of the root type at once.
    """
    rows, _ = _follow(collection, root_type, path, roots)
    return rows


def _follow(collection, root_type, path, roots=None):
    from recordloom.operators.search import filter_ids

    table = collection[root_type]
    df = table.df if roots is None else filter_ids(table, roots)
    rows = df.withColumn(ROOT_COLUMN, quoted(table.primary_key))
    for relation in path:
        rows, table = hop(collection, rows, table, relation, [ROOT_COLUMN])
    return rows, table


def member_page(
    collection: Collection,
    array_type: str,
    array_path: Sequence[str],
    page_size: int,
    offset: int = 0,
    roots: Sequence[str] | DataFrame | None = None,
) -> tuple[DataFrame, RecordTable]:
    """Per array root, the page of distinct members in key order.

    Rows are ``(sys_array_root, sys_root, sys_rank)``. Repeats of a member are
    dropped before members are ranked, spread over all tasks, and the rank bound
    then keeps at most a page per root.
    """
    rows, member = _follow(collection, array_type, array_path, roots)
    pairs = rows.select(
        F.col(ROOT_COLUMN).alias(ARRAY_ROOT), quoted(member.primary_key).alias("member")
    ).distinct()
    rank = F.row_number().over(Window.partitionBy(ARRAY_ROOT).orderBy("member"))
    ranked = pairs.withColumn("sys_rank", rank).filter(F.col("sys_rank") <= offset + page_size)
    paged = ranked.filter(F.col("sys_rank") > offset)
    return paged.withColumnRenamed("member", ROOT_COLUMN), member


def follow_members(
    collection: Collection,
    array_type: str,
    array_path: Sequence[str],
    path: Sequence[str],
    page_size: int,
    offset: int = 0,
    roots: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """A page of each root's array members, and the records ``path`` leads to from them.

    Keyed by ``sys_array_root`` and, for the member, ``sys_root``.
    """
    members, table = member_page(collection, array_type, array_path, page_size, offset, roots)
    carry = [ARRAY_ROOT, ROOT_COLUMN]
    rows = members.select(*carry).join(
        table.df, F.col(ROOT_COLUMN) == quoted(table.primary_key), "inner"
    )
    for relation in path:
        rows, table = hop(collection, rows, table, relation, carry)
    return rows
