"""Snapshot manifests: tables with Parquet paths, keys and relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.constants import MANIFEST_DEFAULT_KEY
from recordloom.errors import MissingObject
from recordloom.model import Collection, RecordTable, tag
from recordloom.sources.nested import convert_columns

SCHEMA = """
snapshot struct<
  id string,
  tables array<struct<name string, primaryKey array<string>,
    columns array<struct<name string, datatype string, array_of boolean>>>>,
  relationships array<struct<name string,
    `from` struct<`table` string, `column` string>,
    `to` struct<`table` string, `column` string>>>>,
format struct<parquet struct<location struct<tables array<struct<name string, paths array<string>>>>>>
"""


def read_manifest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def chosen_key(keys: Column) -> Column:
    """The only key of a table, or the default where it has none or several."""
    return F.when(F.size(keys) == 1, F.get(keys, 0)).otherwise(F.lit(MANIFEST_DEFAULT_KEY))


def manifest_keys(manifests: DataFrame) -> DataFrame:
    """``(snapshot_id, table, primary_key)`` of every table a snapshot declares."""
    tables = manifests.select(
        F.col("snapshot.id").alias("snapshot_id"), F.explode("snapshot.tables").alias("t")
    )
    return tables.select(
        "snapshot_id", F.col("t.name").alias("table"), chosen_key(F.col("t.primaryKey")).alias("primary_key")
    )


def manifest_tables(manifests: DataFrame) -> DataFrame:
    """Tables with data files: ``(snapshot_id, table, primary_key, paths)``.

    ``primary_key`` is null for a table the snapshot does not declare.
    """
    files = manifests.select(
        F.col("snapshot.id").alias("snapshot_id"),
        F.explode("format.parquet.location.tables").alias("f"),
    ).select("snapshot_id", F.col("f.name").alias("table"), F.col("f.paths").alias("paths"))
    return files.join(manifest_keys(manifests), ["snapshot_id", "table"], "left")


def manifest_relations(manifests: DataFrame) -> DataFrame:
    """Relationships whose target column is the target table's primary key."""
    relations = manifests.select(
        F.col("snapshot.id").alias("snapshot_id"),
        F.explode("snapshot.relationships").alias("r"),
    ).select(
        "snapshot_id",
        F.col("r.from.table").alias("from_table"),
        F.col("r.from.column").alias("from_column"),
        F.col("r.to.table").alias("to_table"),
        F.col("r.to.column").alias("to_column"),
    )
    return valid_relations(relations, manifest_keys(manifests), ["snapshot_id"])


def valid_relations(relations: DataFrame, keys: DataFrame, scope: Sequence[str]) -> DataFrame:
    targets = keys.select(
        *scope, F.col("table").alias("to_table"), F.col("primary_key").alias("to_column")
    )
    return relations.join(targets, [*scope, "to_table", "to_column"], "left_semi")


def base_columns(df: DataFrame, relation_columns: Sequence[str]) -> DataFrame:
    """All columns but the relations, which a later pass writes."""
    return df.drop(*relation_columns)


def load_manifest(spark: SparkSession, path: str) -> Collection:
    """All tables of one manifest as related record tables.

    The manifest itself is configuration and read on the driver; the tables are
    only ever scanned by executors. Relation columns come from the same scan as
    the base attributes and hold the bare ids of their targets.
    """
    manifest = read_manifest(spark, path)
    relations: dict[str, dict[str, str]] = {}
    for r in manifest_relations(manifest).collect():
        relations.setdefault(r["from_table"], {})[r["from_column"]] = r["to_table"]
    tables = []
    for row in manifest_tables(manifest).collect():
        name, key = row["table"], row["primary_key"]
        if key is None:
            raise MissingObject(f"table {name} has files but is not declared")
        df = spark.read.parquet(*row["paths"])
        related = {c: t for c, t in relations.get(name, {}).items() if c in df.columns}
        converted = convert_columns(df, ids=[key, *related])
        tables.append(RecordTable(name, tag(converted, key, relations=related), key))
    return Collection.of(*tables)
