"""Edge tables kept up to date by what changes.

An array relation held as edges ``(from_id, to_id)`` changes by a delta: of each touched record the edges that it has no
longer, and those that are new. A delta is small where few records change, and it can be applied to any copy of the
edges, such as the two that ``recordloom.sinks.edges`` stores, one dealt by ``from_id`` and one by ``to_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.model import RecordTable, quoted
from recordloom.operators.traverse import bare_id


def given_edges(records: DataFrame, key: str, relation: str) -> DataFrame:
    """Distinct ``(from_id, to_id)`` of an array column of relations; members that are null are none."""
    pairs = records.select(quoted(key).alias("from_id"), F.explode(quoted(relation)).alias("uri"))
    return pairs.select("from_id", bare_id(F.col("uri")).alias("to_id")).where(F.col("to_id").isNotNull()).distinct()


def edge_delta(current: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """``(from_id, to_id, added)``: how the edges of ``touched.record_id`` change to become ``new``.

    ``current`` is cut down to the touched records before it is compared. Edges that stay are in no row.
    """
    ids = touched.select(F.col("record_id").alias("touched_id")).distinct()
    old = current.join(ids, F.col("from_id") == F.col("touched_id"), "left_semi").select("from_id", "to_id")
    # one exchange by the record: an edge of both sides has a sum of 3, old ones 1, new ones 2
    sides = old.withColumn("side", F.lit(1)).unionByName(new.select("from_id", "to_id", F.lit(2).alias("side")))
    seen = sides.groupBy("from_id", "to_id").agg(F.bit_or("side").alias("side"))
    return seen.where("side < 3").select("from_id", "to_id", (F.col("side") == 2).alias("added"))


def apply_delta(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """``edges`` after a delta, whatever order edges or the delta come in; a delta applied twice has no more effect."""
    changed = delta.select(F.col("from_id").alias("changed_from"), F.col("to_id").alias("changed_to"))
    same = (F.col("from_id") == F.col("changed_from")) & (F.col("to_id") == F.col("changed_to"))
    kept = edges.select("from_id", "to_id").join(changed, same, "left_anti")
    return kept.unionByName(delta.where("added").select("from_id", "to_id"))


def upserted_edges(table: RecordTable, records: DataFrame) -> dict[str, DataFrame]:
    """For each relation that ``table`` holds as edges and ``records`` gives as an array: what an upsert changes.

    A record's array replaces all its edges, a null one leaves none.
    """
    touched = records.select(quoted(table.primary_key).alias("record_id"))
    return {
        relation: edge_delta(edges, touched, given_edges(records, table.primary_key, relation))
        for relation, (_, edges) in table.edge_tables.items()
        if relation in records.columns
    }


def with_deltas(table: RecordTable, deltas: dict[str, DataFrame]) -> RecordTable:
    """``table`` with its edges changed by the deltas of some of its relations."""
    held = {
        relation: (target, apply_delta(edges, deltas[relation]) if relation in deltas else edges)
        for relation, (target, edges) in table.edge_tables.items()
    }
    return RecordTable(table.name, table.df, table.primary_key, held)


def with_given_edges(table: RecordTable, records: DataFrame) -> RecordTable:
    """``table`` with the edges that an upsert leaves: where no delta is to be kept, those of touched records go and the given ones come.

    Edges are matched by the record they lead from alone, once.
    """
    ids = records.select(quoted(table.primary_key).alias("touched_id")).distinct()
    held = {}
    for relation, (target, edges) in table.edge_tables.items():
        if relation in records.columns:
            # as with a delta, an edge to nothing is never among those that go
            gone = (F.col("from_id") == F.col("touched_id")) & F.col("to_id").isNotNull()
            kept = edges.select("from_id", "to_id").join(ids, gone, "left_anti")
            edges = kept.unionByName(given_edges(records, table.primary_key, relation))
        held[relation] = (target, edges)
    return RecordTable(table.name, table.df, table.primary_key, held)


def without_edges_of(table: RecordTable, ids: DataFrame) -> RecordTable:
    """``table`` without the edges that lead from ``ids.record_id``, which are deleted."""
    gone = ids.select(F.col("record_id").alias("gone"))
    held = {
        relation: (target, edges.join(gone, F.col("from_id") == F.col("gone"), "left_anti"))
        for relation, (target, edges) in table.edge_tables.items()
    }
    return RecordTable(table.name, table.df, table.primary_key, held)
