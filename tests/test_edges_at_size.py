"""What keeps edges cheap where there are many."""

import uuid

from pyspark.sql import functions as F

from recordloom.functions.relation import relation_uri
from recordloom.model import AttributeType, RecordTable, tag
from recordloom.operators.ingest import merge_records
from recordloom.plans.star import order_lines
from recordloom.sinks.edges import FROM, TO, read_edges, write_edges
from tests.conftest import collect


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_an_upsert_matches_edges_by_their_record_once(spark):
    edges = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "3"), ("c", None)], "from_id string, to_id string")
    table = RecordTable("t", tag(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "id"), "id", {"parts": ("part", edges)})
    rows = [("a", ["2", "4"]), ("c", None)]
    uris = F.transform("parts", lambda p: relation_uri("part", p)).alias("parts")
    given = spark.createDataFrame(rows, "id string, parts array<string>").select("id", uris)
    given = tag(given, "id", {"parts": AttributeType.ARRAY_OF_RELATION})
    after = merge_records(table, "t", "id", given).edge_tables["parts"][1]
    assert collect(after) == [("a", "2"), ("a", "4"), ("b", "1"), ("c", None)]
    assert "bit_or" not in _plan(after)


def test_both_copies_come_from_one_reading(spark, tmp_path):
    name = F.udf(lambda _: uuid.uuid4().hex, "string").asNondeterministic()
    edges = spark.range(50).select(F.col("id").cast("string").alias("from_id"), name("id").alias("to_id"))
    path = str(tmp_path / "edges")
    write_edges(edges, path, buckets=2)
    assert collect(read_edges(spark, path, FROM)) == collect(read_edges(spark, path, TO))


def test_lines_are_told_apart_as_numbers(spark, sf):
    """The distinct pairs are of whole numbers, which become text afterwards."""
    assert _plan(order_lines(spark, sf, "l_partkey")).startswith("Project")
