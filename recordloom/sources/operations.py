"""JSON change batches: arrays of ``{operation, record}``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.convert import convert
from recordloom.functions.infer import json_type
from recordloom.model import AttributeType as A
from recordloom.operators.inference import column_type_aggregate, infer_columns
from recordloom.sources.places import with_place

# Attributes stay variants: text and numbers remain distinguishable.
SCHEMA = "operation string, record struct<id string, type string, attributes map<string, variant>>"


def read_operations(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Operations in file order: ``(seq, operation, record_id, type, attributes)``.

    Files have one operation per line; one array per file needs ``multi_line``, with
    which a file can't be split among tasks. ``seq`` orders files by name and rows by
    their place in them.
    """
    rows = spark.read.schema(SCHEMA).json(paths, multiLine=multi_line)
    return flatten_operations(with_place(rows, "seq"))


def parse_operations(df: DataFrame, text: str, seq: str) -> DataFrame:
    """Operations from a column with one JSON operation per row."""
    rows = df.select(F.from_json(F.col(text), SCHEMA).alias("op"), F.col(seq).alias("seq"))
    return flatten_operations(rows.select("seq", "op.*"))


def flatten_operations(rows: DataFrame) -> DataFrame:
    return rows.select(
        "seq",
        F.lower("operation").alias("operation"),
        F.col("record.id").alias("record_id"),
        F.col("record.type").alias("type"),
        F.col("record.attributes").alias("attributes"),
    )


def infer_operations(ops: DataFrame, attributes: Sequence[str] | None = None) -> DataFrame:
    """Attribute types over the upserts: ``(attribute, attribute_type)``.

    Without ``attributes`` those that occur are found in the same pass: each value
    is typed where it is read, and one small buffer per name and task is shuffled.
    """
    upserts = ops.filter(F.col("operation") == "upsert")
    if attributes is not None:
        kinds = {a: json_type(F.col("attributes").getItem(a)) for a in attributes}
        return infer_columns(upserts, kinds, F.col("seq"))
    values = upserts.select("seq", F.explode("attributes").alias("attribute", "value"))
    typed = values.select("seq", "attribute", json_type("value").alias("kind"))
    return typed.groupBy("attribute").agg(
        column_type_aggregate(F.col("kind"), F.col("seq")).alias("attribute_type")
    )


def attribute_names(ops: DataFrame) -> list[str]:
    """Names given by any upsert; as many rows as attributes reach the driver."""
    names = ops.select(F.explode(F.map_keys("attributes")).alias("name")).distinct()
    return sorted(r["name"] for r in names.collect())


def typed_feed(ops: DataFrame, schema: Mapping[str, A]) -> DataFrame:
    """A change feed with one typed column per attribute and the ``given`` names."""
    columns = []
    for name, kind in schema.items():
        value = _typed_value(F.col("attributes").getItem(name), kind.stored)
        columns.append(value.cast(kind.stored.spark_type).alias(name))
    given = F.map_keys("attributes").alias("given")
    return ops.select("seq", "operation", "record_id", given, *columns)


def _typed_value(v: Column, kind: A) -> Column:
    if kind.is_array:
        values = F.variant_get(v, "$", "array<variant>")
        return F.transform(values, lambda e: _typed(e, kind.base))
    return _typed(v, kind)


def _typed(v: Column, kind: A) -> Column:
    if kind is A.JSON:
        return F.when(F.schema_of_variant(v) != "VOID", F.to_json(v))
    text = F.variant_get(v, "$", "string")
    if kind is A.BOOLEAN:
        return F.lower(text) == "true"
    if kind is A.DATE_TIME:
        return F.translate(text, "t", "T").cast("timestamp_ntz")
    return text if kind.spark_type.simpleString() == "string" else convert(text, A.STRING, kind)
