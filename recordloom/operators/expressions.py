"""Values looked up along relations, projected to JSON.

An expression is a Python value: a ``Lookup`` or a dict / list / literal with
lookups inside. ``evaluate`` answers many expressions for many records in one
plan, and follows each distinct path once, whatever number of expressions use it.

A path of scalar relations reaches at most one record, so its values are added
to the root rows by left joins and need no grouping; where records share a key, and
such a path would reach more than one, the plan fails. A path with an array
relation reaches many; their values are grouped per root into a JSON array.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.constants import ROOT_COLUMN
from recordloom.errors import InvalidRelation
from recordloom.functions.jsontext import value_json
from recordloom.functions.relation import relation_uri
from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable, quoted
from recordloom.operators.search import filter_ids
from recordloom.operators.traverse import ARRAY_ROOT, _follow, bare_id, member_page
from recordloom.operators.write import once

RECORD_ID = "record_id"


@dataclass(frozen=True)
class Lookup:
    """An attribute of the record that ``path`` leads to from the root."""

    path: tuple[str, ...]
    attribute: str


def this(*steps: str) -> Lookup:
    """``this("customer", "nation", "n_name")``: relations first, attribute last."""
    return Lookup(tuple(steps[:-1]), steps[-1])


def lookups_in(expression) -> set[Lookup]:
    if isinstance(expression, Lookup):
        return {expression}
    if isinstance(expression, Mapping):
        return set().union(*map(lookups_in, expression.values()))
    if isinstance(expression, (list, tuple)):
        return set().union(*map(lookups_in, expression))
    return set()


def _render(expression, found: Mapping[Lookup, Column]) -> Column:
    """JSON text of an expression, given the JSON text of its lookups."""
    if isinstance(expression, Lookup):
        return F.coalesce(found[expression], F.lit("null"))
    if isinstance(expression, Mapping):
        members = [
            F.concat(F.lit(json.dumps(str(k), ensure_ascii=False) + ":"), _render(v, found))
            for k, v in expression.items()
        ]
        return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    if isinstance(expression, (list, tuple)):
        return F.concat(
            F.lit("["), F.concat_ws(",", *[_render(v, found) for v in expression]), F.lit("]")
        )
    return F.lit(json.dumps(expression, ensure_ascii=False))


def _attribute_json(table: RecordTable, attribute: str) -> Column:
    """JSON text of an attribute; the key answers to its name in any case."""
    if attribute.lower() == table.primary_key.lower():
        return value_json(quoted(table.primary_key), A.STRING)
    if attribute not in table.df.columns:
        return F.lit(None).cast("string")
    kind, c = table.type(attribute), quoted(attribute)
    if kind is A.RELATION:
        c = F.when(c.isNotNull(), relation_uri(table.relations[attribute], bare_id(c)))
    return value_json(c, kind)


def _check(collection: Collection, root_type: str, lookups: set[Lookup]) -> dict[tuple, bool]:
    """Each distinct path, and whether it has an array relation."""
    has_array = {}
    for lookup in lookups:
        table, array = collection[root_type], False
        for relation in lookup.path:
            if relation not in table.relations:
                raise InvalidRelation(f"{table.name} has no relation {relation!r}")
            array |= table.type(relation).is_array
            table = collection[table.relations[relation]]
        has_array[lookup.path] = array
    return has_array


def _scalar_rows(collection, table, roots, wanted: Mapping[tuple, list[Lookup]]):
    """Root rows with one column per lookup on a scalar path, and which paths exist.

    Paths with a common start share its joins.
    """
    nodes = sorted({p[:i] for p in wanted for i in range(len(p) + 1)}, key=len)
    nodes = nodes or [()]
    number = {node: i for i, node in enumerate(nodes)}
    names: dict[Lookup, str] = {}

    def columns(node, at: RecordTable) -> list[Column]:
        out = []
        for j, lookup in enumerate(wanted.get(node, [])):
            names[lookup] = f"v{number[node]}_{j}"
            out.append(_attribute_json(at, lookup.attribute).alias(names[lookup]))
        for child in nodes:
            if len(child) == len(node) + 1 and child[: len(node)] == node:
                out.append(bare_id(quoted(child[-1])).alias(f"r{number[child]}"))
        return out

    tables = {(): table}
    rows = roots.select(quoted(table.primary_key).alias(RECORD_ID), *columns((), table))
    for node in nodes[1:]:
        parent = tables[node[:-1]]
        target = tables[node] = collection[parent.relations[node[-1]]]
        key = f"k{number[node]}"
        # a second record with a key would be a second value, which a scalar path can't have
        right = target.df.select(once(quoted(target.primary_key)).alias(key), *columns(node, target))
        rows = rows.join(right, F.col(f"r{number[node]}") == F.col(key), "left")
    present = {n: F.col(f"k{number[n]}").isNotNull() if n else F.lit(True) for n in nodes}
    return rows, {lk: F.col(n) for lk, n in names.items()}, present


def lookup_rows(collection, root_type, path, attributes: Sequence[str], roots=None) -> DataFrame:
    """Long form: one row ``(record_id, target_id, attribute columns…)`` per record reached."""
    rows, table = _follow(collection, root_type, path, roots)
    values = [_attribute_json(table, a).alias(a) for a in attributes]
    target = quoted(table.primary_key).alias("target_id")
    return rows.select(F.col(ROOT_COLUMN).alias(RECORD_ID), target, *values)


def _array_values(collection, root_type, path, lookups, roots, names) -> DataFrame:
    """Per root, one JSON array per lookup on a path with an array relation.

    Values come in target key order; nulls are dropped.
    """
    rows, table = _follow(collection, root_type, path, roots)
    values = rows.select(
        F.col(ROOT_COLUMN).alias("sys_id"),
        F.struct(
            quoted(table.primary_key).alias("key"),
            *[_attribute_json(table, lk.attribute).alias(names[lk]) for lk in lookups],
        ).alias("found"),
    )
    grouped = values.groupBy("sys_id").agg(F.array_sort(F.collect_list("found")).alias("found"))
    texts = [
        F.concat(
            F.lit("["), F.array_join(F.col("found").getField(names[lk]), ","), F.lit("]")
        ).alias(names[lk])
        for lk in lookups
    ]
    return grouped.select("sys_id", *texts)


def evaluate(
    collection: Collection,
    root_type: str,
    expressions: Mapping[str, object],
    roots: Sequence[str] | DataFrame | None = None,
    no_rows: str | None = "[]",
) -> DataFrame:
    """``record_id`` and one JSON text column per expression.

    A lookup on a scalar path gives its value or null. One with an array relation
    on its path gives a JSON array, ``no_rows`` where the path leads nowhere.
    """
    return _evaluate(collection, root_type, expressions, roots, no_rows)[0]


def _evaluate(collection, root_type, expressions, roots, no_rows):
    table = collection[root_type]
    lookups = lookups_in(list(expressions.values()))
    has_array = _check(collection, root_type, lookups)
    by_path: dict[tuple, list[Lookup]] = {}
    for lookup in sorted(lookups, key=lambda lk: (lk.path, lk.attribute)):
        by_path.setdefault(lookup.path, []).append(lookup)
    scalar = {p: ls for p, ls in by_path.items() if not has_array[p]}

    df = table.df if roots is None else filter_ids(table, roots)
    rows, found, present = _scalar_rows(collection, table, df, scalar)
    reached = [present[p] for p in scalar]
    for i, path in enumerate(p for p in by_path if has_array[p]):
        names = {lk: f"a{i}_{j}" for j, lk in enumerate(by_path[path])}
        values = _array_values(collection, root_type, path, by_path[path], roots, names)
        values = values.withColumnRenamed("sys_id", f"s{i}")
        rows = rows.join(values, F.col(RECORD_ID) == F.col(f"s{i}"), "left")
        for lk, name in names.items():
            found[lk] = F.coalesce(F.col(name), F.lit(no_rows))
        reached.append(F.col(f"s{i}").isNotNull())
    any_reached = reached[0] if reached else F.lit(True)
    for r in reached[1:]:
        any_reached = any_reached | r
    rendered = [_render(e, found).alias(name) for name, e in expressions.items()]
    return rows.select(RECORD_ID, *rendered), rows.select(
        RECORD_ID, any_reached.alias("sys_reached"), *rendered
    )


def evaluate_bounded(
    collection: Collection,
    root_type: str,
    expressions: Mapping[str, object],
    max_values: int,
    roots: Sequence[str] | DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``evaluate``, with records whose arrays are too long for one cell set apart.

    Returns the rows of ``evaluate`` for every record none of whose array lookups
    reaches more than ``max_values`` records, and for the others all values in
    long form: ``(record_id, path, attribute, target_id, value)``. Together they
    are whole; no task ever gathers more than ``max_values`` values of a record.

    How many records a root reaches is counted with map-side combining, and at
    most one in ``max_values`` of the reached records can make a root large.
    """
    table = collection[root_type]
    lookups = lookups_in(list(expressions.values()))
    has_array = _check(collection, root_type, lookups)
    large = None
    for path in sorted(p for p, array in has_array.items() if array):
        reached, _ = _follow(collection, root_type, path, roots)
        counts = reached.groupBy(F.col(ROOT_COLUMN).alias(RECORD_ID)).agg(F.count(F.lit(1)).alias("n"))
        found = counts.filter(F.col("n") > max_values).select(RECORD_ID)
        large = found if large is None else large.unionByName(found)
    if large is None:
        large = table.df.select(quoted(table.primary_key).alias(RECORD_ID)).limit(0)
    large = large.distinct()
    df = table.df if roots is None else filter_ids(table, roots)
    big = large.select(F.col(RECORD_ID).alias("sys_big"))
    small = df.join(big, quoted(table.primary_key) == F.col("sys_big"), "left_anti")
    small = small.select(quoted(table.primary_key).alias(RECORD_ID))
    shaped = evaluate(collection, root_type, expressions, small)
    long = None
    for lookup in sorted(lookups, key=lambda lk: (lk.path, lk.attribute)):
        rows = lookup_rows(collection, root_type, lookup.path, [lookup.attribute], large)
        rows = rows.select(
            RECORD_ID, F.lit(".".join(lookup.path)).alias("path"), F.lit(lookup.attribute).alias("attribute"),
            "target_id", quoted(lookup.attribute).alias("value"),
        )
        long = rows if long is None else long.unionByName(rows)
    return shaped, long


def evaluate_members(
    collection: Collection,
    array_type: str,
    array_path: Sequence[str],
    expressions: Mapping[str, object],
    page_size: int,
    offset: int = 0,
    roots: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Expressions for a page of each root's array members.

    One member more than the page is ranked to learn whether another page
    follows (``has_next``). Members none of whose lookups lead anywhere are left
    out; a lookup over an array that leads nowhere is the JSON text ``null``.
    """
    members, table = member_page(
        collection, array_type, array_path, page_size + 1, offset, roots
    )
    per_root = Window.partitionBy(ARRAY_ROOT)
    more = F.max("sys_rank").over(per_root) > offset + page_size
    paged = members.withColumn("has_next", more).filter(F.col("sys_rank") <= offset + page_size)
    # the extra member is evaluated too: with the same rank bound everywhere, the
    # page is ranked once and its exchange reused
    ids = members.select(F.col(ROOT_COLUMN).alias(RECORD_ID)).distinct()
    _, rows = _evaluate(collection, table.name, expressions, ids, None)
    rows = rows.filter("sys_reached").drop("sys_reached")
    keyed = paged.select(ARRAY_ROOT, F.col(ROOT_COLUMN).alias("member"), "has_next")
    return keyed.join(rows, F.col("member") == F.col(RECORD_ID)).drop("member")
