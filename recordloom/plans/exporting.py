"""Exports and the versioned table sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME
from recordloom.model import RecordTable, tag
from recordloom.plans.changing import _UPSERT, customers, _latest_events
from recordloom.plans.importing import scratch
from recordloom.plans.registry import query
from recordloom.plans.star import records
from recordloom.sinks import export as X
from recordloom.sinks.table import read_table, upsert_table, write_version

_SQL_NUMBER = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')"


def _orders(spark, sf) -> RecordTable:
    """Orders with a null, a list and a list of relations among their attributes."""
    orders = records(spark, sf, "orders")
    df = orders.df.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice", "o_orderdate",
        F.array(F.col("o_orderstatus"), F.lit(None).cast("string"), F.col("o_orderpriority")).alias("words"),
        F.array("o_custkey", "o_orderkey").alias("customers"),
    )
    return orders.with_df(tag(df, "o_orderkey", relations={"customers": "customer"}))


@query(
    "tsv_export",
    f"""SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, '["' || o_custkey || '","' || o_orderkey || '"]' AS customers,
          '{RELATION_SCHEME}/customer/' || o_custkey AS o_custkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
          {_SQL_NUMBER.format("o_totalprice")} AS o_totalprice, coalesce(nullif(o_orderstatus, 'P'), '') AS status,
          '["' || o_orderstatus || '",null,"' || o_orderpriority || '"]' AS words FROM orders""",
)
def tsv_export(spark, sf):
    return X.tsv_cells(_orders(spark, sf))


@query("tsv_export_file", "SELECT 'c_custkey' AS key_header, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer")
def tsv_export_file(spark, sf):
    """The files as written: the key leads, every row comes back."""
    path = scratch(spark, "export")
    X.write_tsv(customers(spark, sf), path)
    back = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    first = back.columns[0]
    return back.agg(
        F.lit(first).alias("key_header"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(first).cast("long")).alias("keys")
    )


@query(
    "entity_ops",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS name, 'orders' AS "entityType",
          '[{{"op":"RemoveAttribute","attributeName":"pfb:customers"}},' ||
          '{{"op":"CreateAttributeEntityReferenceList","attributeListName":"pfb:customers"}},' ||
          '{{"op":"AddListMember","attributeListName":"pfb:customers","newMember":{{"entityType":"customer","entityName":"' || o_custkey || '"}}}},' ||
          '{{"op":"AddListMember","attributeListName":"pfb:customers","newMember":{{"entityType":"customer","entityName":"' || o_orderkey || '"}}}},' ||
          '{{"op":"AddUpdateAttribute","attributeName":"pfb:o_custkey","addUpdateAttribute":{{"entityType":"customer","entityName":"' || o_custkey || '"}}}},' ||
          '{{"op":"AddUpdateAttribute","attributeName":"pfb:o_orderdate","addUpdateAttribute":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}},' ||
          '{{"op":"AddUpdateAttribute","attributeName":"pfb:o_totalprice","addUpdateAttribute":' || {_SQL_NUMBER.format("o_totalprice")} || '}},' ||
          CASE WHEN o_orderstatus = 'P' THEN '' ELSE '{{"op":"AddUpdateAttribute","attributeName":"pfb:status","addUpdateAttribute":"' || o_orderstatus || '"}},' END ||
          '{{"op":"RemoveAttribute","attributeName":"pfb:words"}},{{"op":"CreateAttributeValueList","attributeName":"pfb:words"}},' ||
          '{{"op":"AddListMember","attributeListName":"pfb:words","newMember":"' || o_orderstatus || '"}},' ||
          '{{"op":"AddListMember","attributeListName":"pfb:words","newMember":null}},' ||
          '{{"op":"AddListMember","attributeListName":"pfb:words","newMember":"' || o_orderpriority || '"}}]' AS operations FROM orders""",
)
def entity_ops(spark, sf):
    return X.entity_operations(_orders(spark, sf), prefix="pfb")


def _named(spark, sf) -> RecordTable:
    table = records(spark, sf, "part")
    df = table.df.select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("entityType"), F.col("p_size").alias("part_id"),
        F.col("p_type").alias("import:kind"), F.col("p_retailprice").alias("price"),
    )
    return table.with_df(tag(df, "p_partkey"))


@query(
    "prefix_rename",
    """SELECT CAST(p_partkey AS VARCHAR) p_partkey, p_name AS "pfb:part_name", p_brand AS "pfb:entityType", p_size AS "pfb:part_id",
              p_type AS "import:kind", p_retailprice AS "pfb:price" FROM part""",
)
def prefix_rename(spark, sf):
    return X.prefixed(_named(spark, sf), "pfb")


@query(
    "prefix_rename_manifest",
    """SELECT CAST(p_partkey AS VARCHAR) p_partkey, p_name AS "tdr:name", p_brand AS "tdr:entityType", p_size AS "tdr:part_id",
              p_type AS "import:kind", p_retailprice AS price FROM part""",
)
def prefix_rename_manifest(spark, sf):
    return X.prefixed(_named(spark, sf), "tdr")


@query("sink_upsert", _UPSERT)
def sink_upsert(spark, sf):
    """A first version written, changes upserted into a second, the newest read back."""
    path = scratch(spark, "table")
    table = customers(spark, sf)
    write_version(table.df, path, table.primary_key)
    upsert_table(spark, path, "customer", table.primary_key, _latest_events(spark, sf))
    return read_table(spark, path, "customer").df
