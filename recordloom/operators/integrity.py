"""Checks between records: relations that dangle, block or contradict."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME
from recordloom.errors import InvalidRelation
from recordloom.functions.relation import relation_id
from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable, quoted
from recordloom.operators.traverse import bare_id, edges


def relation_pairs(table: RecordTable, relation: str) -> DataFrame:
    """``(from_id, to_id)`` of a relation, scalar or array."""
    if table.type(relation).is_array:
        return edges(table, relation)
    c = quoted(relation)
    return table.df.filter(c.isNotNull()).select(
        quoted(table.primary_key).alias("from_id"), bare_id(c).alias("to_id")
    )


def dangling_relations(collection: Collection, name: str, relation: str) -> DataFrame:
    """Relations of a table that point at no record."""
    table = collection[name]
    target = collection[table.relations[relation]]
    keys = target.df.select(quoted(target.primary_key).alias("key"))
    pairs = relation_pairs(table, relation)
    return pairs.join(keys, F.col("to_id") == F.col("key"), "left_anti")


def referrers(collection: Collection, name: str) -> list[tuple[str, str]]:
    """``(record type, relation)`` of every relation that points at a type."""
    return [
        (t.name, relation)
        for t in collection.tables.values()
        for relation, target in sorted(t.relations.items())
        if target == name
    ]


def blocked_deletes(
    collection: Collection, name: str, ids: DataFrame, leaving: DataFrame | None = None
) -> DataFrame:
    """Requested ids that other records still refer to, with the number of references.

    Edges *from* a deleted record go with it; those to it block the delete. References of
    records in ``leaving.record_id``, which are of the same type and go as well, don't count.

    References are cut down to the requested ids before they are counted, and counted
    where they are before they are shuffled, so a hot target is one row per task.
    """
    asked = ids.select(F.col("record_id").alias("to_id"))
    found = None
    for source, relation in referrers(collection, name):
        pairs = relation_pairs(collection[source], relation).join(asked, "to_id", "left_semi")
        if leaving is not None and source == name:
            gone = leaving.select(F.col("record_id").alias("from_id"))
            pairs = pairs.join(gone, "from_id", "left_anti")
        found = pairs.select("to_id") if found is None else found.union(pairs.select("to_id"))
    if found is None:
        return asked.select(F.col("to_id").alias("record_id"), F.lit(0).cast("long").alias("references")).limit(0)
    return found.groupBy(F.col("to_id").alias("record_id")).agg(F.count(F.lit(1)).alias("references"))


def replace_edges(current: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after the records in ``touched.record_id`` got the edges ``new``."""
    ids = touched.select(F.col("record_id").alias("touched_id")).distinct()
    kept = current.join(ids, F.col("from_id") == F.col("touched_id"), "left_anti")
    return kept.unionByName(new)


def relation_problems(table: RecordTable, targets: DataFrame) -> DataFrame:
    """``(attribute, problem)`` for relation values that contradict a table's schema.

    ``targets`` is what ``relation_targets`` found: a row per column and target.
    """
    known = table.relations
    attribute, one = F.col("attribute"), F.col("target")
    plain = [n for n in table.types if n not in known]
    contradicts = F.lit(False)
    for name, target in known.items():
        contradicts = contradicts | ((attribute == name) & (one != target))
    per_column = targets.groupBy("attribute").agg(
        F.count("target").alias("targets"),
        F.count_if(one.isNull()).alias("mixed"),
        F.min("target").alias("target"),
    )
    problem = (
        F.when(F.col("mixed") > 0, "holds arrays of more than one record type")
        .when(attribute.isin(*plain), "exists and is no relation")
        .when((F.col("targets") > 1) | contradicts, "refers to more than one record type")
    )
    return per_column.select("attribute", problem.alias("problem")).filter("problem is not null")


def validate_relations(table: RecordTable, targets: DataFrame) -> None:
    """Refuse relation values that contradict the schema of an existing table."""
    problems = sorted(f"{r['attribute']} {r['problem']}" for r in relation_problems(table, targets).collect())
    if problems:
        raise InvalidRelation("; ".join(problems))


def type_mismatches(
    df: DataFrame, key: str, record_type: str, cell_types: Mapping[str, Column], schema: Mapping[str, A]
) -> DataFrame:
    """A message per cell whose own type differs from the column's.

    Rows are ``(record_id, attribute, message)``; cells of the right type, and
    attributes the schema does not know, yield none.
    """
    checked = [n for n in schema if n in cell_types]
    # the types are a projection of their own, so that each cell is typed once
    typed = df.select(
        quoted(key).alias("record_id"), *[cell_types[n].alias(f"t{i}") for i, n in enumerate(checked)]
    )
    problems = []
    for i, name in enumerate(checked):
        expected, found = schema[name].value, F.col(f"t{i}")
        text = F.concat(
            F.col("record_id"),
            F.lit(": "),
            found,
            F.lit(f" given for {expected} attribute {name} of {record_type}"),
        )
        problem = F.struct(F.lit(name).alias("attribute"), text.alias("message"))
        problems.append(F.when(found != expected, problem))
    rows = typed.select("record_id", F.explode(F.array_compact(F.array(*problems))).alias("p"))
    return rows.select("record_id", "p.*")


def relation_text_problems(c: Column) -> Column:
    """True where a relation cell is not a well-formed URI."""
    return c.isNotNull() & c.startswith(RELATION_SCHEME) & relation_id(c).isNull()
