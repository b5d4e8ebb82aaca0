"""The star-schema tables as record tables that relate to each other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.model import AttributeType, Collection, NativeKey, RecordTable, tag
from recordloom.session import prepare

# table -> (primary key, {relation column: target})
RECORD_TABLES = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "events": ("event_id", {}),
    "documents": ("doc_id", {}),
    "embeddings": ("vec_id", {}),
    "pages": ("page_id", {}),
}
JSON_COLUMNS = {"events": ("props",)}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, name: str) -> RecordTable:
    """A table with text keys, tagged with its relations."""
    key, relations = RECORD_TABLES[name]
    rows = raw(spark, sf_dir, name)
    as_text = {key, *relations}
    json_types = {c: AttributeType.JSON for c in JSON_COLUMNS.get(name, ())}

    def project(df: DataFrame) -> DataFrame:
        return tag(df.select(*[F.col(c).cast("string").alias(c) if c in as_text else F.col(c) for c in df.columns]), key, json_types, relations)

    return RecordTable(name, project(rows), key, native=NativeKey(rows, key, project))


def order_lines(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Distinct ``(from_id, to_id)`` edges from orders to what their lines name."""
    lines = raw(spark, sf_dir, "lineitem")
    # whole numbers differ where their texts do, and are half as large to tell apart
    pairs = lines.select(F.col("l_orderkey").alias("from_id"), F.col(column).alias("to_id")).distinct()
    return pairs.select(*[F.col(c).cast("string").alias(c) for c in pairs.columns])


class _Tables(Mapping):
    """The record tables, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._source = (spark, sf_dir)
        self._read: dict[str, RecordTable] = {}

    def __iter__(self):
        return iter(RECORD_TABLES)

    def __len__(self):
        return len(RECORD_TABLES)

    def __getitem__(self, name: str) -> RecordTable:
        if name not in RECORD_TABLES:
            raise KeyError(name)
        if name not in self._read:
            self._read[name] = self._load(name)
        return self._read[name]

    def _load(self, name: str) -> RecordTable:
        spark, sf_dir = self._source
        table = records(spark, sf_dir, name)
        if name == "orders":
            edges = {
                "parts": ("part", order_lines(spark, sf_dir, "l_partkey")),
                "suppliers": ("supplier", order_lines(spark, sf_dir, "l_suppkey")),
            }
        elif name == "customer":
            placed = raw(spark, sf_dir, "orders").select(
                F.col("o_custkey").cast("string").alias("from_id"),
                F.col("o_orderkey").cast("string").alias("to_id"),
            )
            edges = {"orders": ("orders", placed)}
        else:
            return table
        return RecordTable(name, table.df, table.primary_key, edges, table.native)


def star(spark: SparkSession, sf_dir: str) -> Collection:
    """All related tables; ``parts``, ``suppliers`` and ``orders`` are array relations."""
    return Collection(_Tables(spark, sf_dir))
