"""Filters, sorts, pages and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME
from recordloom.functions.relation import relation_uri
from recordloom.model import AttributeType as A
from recordloom.model import RecordTable, tag
from recordloom.operators import requests as Q
from recordloom.operators import search as S
from recordloom.plans.registry import query
from recordloom.plans.star import raw, records, star

_URI = f"'{RELATION_SCHEME}/"


def _with(table: RecordTable, types=None, relations=None, **columns) -> RecordTable:
    return table.with_df(tag(table.df.withColumns(columns), types=types, relations=relations))


def _where(table: RecordTable, column: str, value, *show: str):
    return table.df.filter(S.term(table, column, value)).select(*show)


def _user_ids(spark, sf):
    events = records(spark, sf, "events").df
    return events.select(F.col("user_id").cast("string").alias("record_id")).distinct()


@query("get_record", "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name FROM customer WHERE c_custkey = 42")
def get_record(spark, sf):
    return S.get_record(records(spark, sf, "customer"), "42").select("c_custkey", "c_name")


@query(
    "record_exists",
    """SELECT u AS record_id, u IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AS found
       FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) u FROM events)""",
)
def record_exists(spark, sf):
    from recordloom.plans.star import raw

    labels = raw(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return S.records_exist(RecordTable("labels", labels, "doc_id"), _user_ids(spark, sf))


@query(
    "filter_ids",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, c_acctbal FROM customer
       WHERE c_custkey IN (SELECT user_id FROM events)""",
)
def filter_ids(spark, sf):
    found = S.filter_ids(records(spark, sf, "customer"), _user_ids(spark, sf))
    return found.select("c_custkey", "c_name", "c_acctbal")


@query(
    "filter_ids_and_term",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name FROM customer
       WHERE c_custkey IN (SELECT user_id FROM events) AND lower(c_mktsegment) = 'building'""",
)
def filter_ids_and_term(spark, sf):
    table = records(spark, sf, "customer")
    found = S.filter_ids(table, _user_ids(spark, sf))
    return found.filter(S.term(table, "c_mktsegment", "Building")).select("c_custkey", "c_name")


@query(
    "term_string",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name FROM customer
       WHERE lower(c_mktsegment) = 'machinery'""",
)
def term_string(spark, sf):
    return _where(records(spark, sf, "customer"), "c_mktsegment", "machinerY", "c_custkey", "c_name")


@query(
    "term_file",
    """SELECT CAST(page_id AS VARCHAR) page_id, url FROM pages
       WHERE lower(url) = (SELECT max(lower(url)) FROM pages)""",
)
def term_file(spark, sf):
    table = _with(records(spark, sf, "pages"), {"url": A.FILE})
    wanted = table.df.agg(F.max(F.lower("url"))).first()[0]
    return _where(table, "url", wanted.upper(), "page_id", "url")


@query(
    "term_relation",
    "SELECT CAST(o_orderkey AS VARCHAR) o_orderkey FROM orders WHERE o_custkey = 37",
)
def term_relation(spark, sf):
    return _where(records(spark, sf, "orders"), "o_custkey", "37", "o_orderkey")


@query(
    "term_array_string",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey FROM orders
       WHERE '9-low' ILIKE o_orderstatus OR '9-low' ILIKE ('%' || substr(o_orderpriority, 3))""",
)
def term_array_string(spark, sf):
    pattern = F.concat(F.lit("%"), F.substring("o_orderpriority", 3, 100))
    table = _with(records(spark, sf, "orders"), words=F.array("o_orderstatus", pattern))
    return _where(table, "words", "9-Low", "o_orderkey")


@query("term_number", "SELECT CAST(p_partkey AS VARCHAR) p_partkey, p_name FROM part WHERE p_size = 11")
def term_number(spark, sf):
    return _where(records(spark, sf, "part"), "p_size", "11.0", "p_partkey", "p_name")


@query(
    "term_array_number",
    """SELECT CAST(event_id AS VARCHAR) event_id FROM events
       WHERE value = 69 OR CAST(json_extract(props, '$.k') AS DOUBLE) = 69""",
)
def term_array_number(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    table = _with(records(spark, sf, "events"), numbers=F.array("value", k))
    return _where(table, "numbers", 69, "event_id")


@query("term_boolean", "SELECT CAST(doc_id AS VARCHAR) doc_id, lang FROM documents WHERE n_chars > 1000")
def term_boolean(spark, sf):
    table = _with(records(spark, sf, "documents"), long=F.col("n_chars") > 1000)
    return _where(table, "long", "TRUE", "doc_id", "lang")


@query(
    "term_array_boolean",
    "SELECT CAST(doc_id AS VARCHAR) doc_id FROM documents WHERE NOT (n_chars > 1000 AND lang = 'en')",
)
def term_array_boolean(spark, sf):
    flags = F.array(F.col("n_chars") > 1000, F.col("lang") == "en")
    return _where(_with(records(spark, sf, "documents"), flags=flags), "flags", False, "doc_id")


@query(
    "term_date",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey FROM orders
       WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'""",
)
def term_date(spark, sf):
    table = _with(records(spark, sf, "orders"), day=F.col("o_orderdate").cast("date"))
    return _where(table, "day", "1998-10-03", "o_orderkey")


@query(
    "term_array_date",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey FROM orders
       WHERE CAST(o_orderdate AS DATE) IN (DATE '1998-10-03', DATE '1998-09-03')""",
)
def term_array_date(spark, sf):
    day = F.col("o_orderdate").cast("date")
    table = _with(records(spark, sf, "orders"), days=F.array(day, F.date_add(day, 30)))
    return _where(table, "days", "1998-10-03", "o_orderkey")


@query(
    "term_datetime",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey FROM orders
       WHERE o_orderdate = TIMESTAMP '1997-05-28 00:00:00'""",
)
def term_datetime(spark, sf):
    return _where(records(spark, sf, "orders"), "o_orderdate", "1997-05-28T00:00:00", "o_orderkey")


@query(
    "term_array_datetime",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey FROM orders
       WHERE o_orderdate IN (TIMESTAMP '1997-05-28', TIMESTAMP '1997-05-27')""",
)
def term_array_datetime(spark, sf):
    stamp = F.col("o_orderdate")
    table = _with(records(spark, sf, "orders"), stamps=F.array(stamp, stamp + F.expr("interval 1 day")))
    return _where(table, "stamps", "1997-05-28T00:00:00", "o_orderkey")


@query(
    "term_array_relation",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey FROM orders
       WHERE o_custkey = 37 OR o_orderkey = 37""",
)
def term_array_relation(spark, sf):
    uris = F.array(relation_uri("customer", F.col("o_custkey")), relation_uri("customer", F.col("o_orderkey")))
    table = _with(records(spark, sf, "orders"), relations={"related": "customer"}, related=uris)
    return _where(table, "related", "37", "o_orderkey")


@query(
    "term_json",
    """SELECT CAST(event_id AS VARCHAR) event_id FROM events
       WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 69 AND len(json_keys(props)) = 1""",
)
def term_json(spark, sf):
    return _where(records(spark, sf, "events"), "props", '{ "k" : 69.0 }', "event_id")


@query(
    "term_array_json",
    """SELECT CAST(event_id AS VARCHAR) event_id FROM events
       WHERE event_type = 'view' AND CAST(json_extract(props, '$.k') AS BIGINT) = 5""",
)
def term_array_json(spark, sf):
    k = F.get_json_object("props", "$.k")
    both = F.concat(F.lit('{"z":"'), F.col("event_type"), F.lit('","a":'), k, F.lit("}"))
    table = _with(records(spark, sf, "events"), {"docs": A.ARRAY_OF_JSON}, docs=F.array("props", both))
    return _where(table, "docs", '{"a":5.00,"z":"view"}', "event_id")


@query("term_false", "SELECT CAST(event_id AS VARCHAR) event_id FROM events WHERE false")
def term_false(spark, sf):
    nothing = F.nullif(F.col("event_type"), F.col("event_type"))
    table = _with(records(spark, sf, "events"), {"nothing": A.NULL}, nothing=nothing)
    return _where(table, "nothing", "x", "event_id")


@query(
    "sort_attr",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, segment FROM
         (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') segment FROM customer)
       ORDER BY segment DESC NULLS FIRST, CAST(c_custkey AS VARCHAR) LIMIT 400""",
)
def sort_attr(spark, sf):
    table = records(spark, sf, "customer")
    table = _with(table, segment=F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    found = S.search(table, sort="segment", descending=True, limit=400)
    return found.select("c_custkey", "segment")


@query(
    "page",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) LIMIT 1000 OFFSET 300""",
)
def page(spark, sf):
    found = S.search(records(spark, sf, "orders"), sort="o_totalprice", limit=1000, offset=300)
    return found.select("o_orderkey", "o_totalprice")


@query(
    "page_deep",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, o_orderpriority FROM orders
       ORDER BY o_orderpriority DESC NULLS FIRST, CAST(o_orderkey AS VARCHAR) LIMIT 500 OFFSET 1000""",
)
def page_deep(spark, sf):
    table = records(spark, sf, "orders")
    found = S.page(table, table.df, "o_orderpriority", True, limit=500, offset=1000, deep_offset=100)
    return found.select("o_orderkey", "o_orderpriority")


@query(
    "page_with_total",
    """SELECT CAST(p_partkey AS VARCHAR) p_partkey, p_name, (SELECT count(*) FROM part) AS total_records
       FROM part WHERE lower(p_type) = 'economy' ORDER BY p_name, CAST(p_partkey AS VARCHAR) LIMIT 50""",
)
def page_with_total(spark, sf):
    table = records(spark, sf, "part")
    found = S.search_with_total(table, where=("p_type", "Economy"), sort="p_name", limit=50)
    return found.select("p_partkey", "p_name", "total_records")


@query("count_records", "SELECT count(*) AS total_records FROM orders")
def count_records(spark, sf):
    return S.count_records(records(spark, sf, "orders"))


@query("scan_ordered", "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, c_acctbal FROM customer ORDER BY 1")
def scan_ordered(spark, sf):
    return S.scan_ordered(records(spark, sf, "customer")).select("c_custkey", "c_name", "c_acctbal")


@query(
    "read_relations",
    f"""SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, {_URI}customer/' || o_custkey AS o_custkey, o_totalprice
        FROM orders""",
)
def read_relations(spark, sf):
    return S.read_records(records(spark, sf, "orders")).select("o_orderkey", "o_custkey", "o_totalprice")


_ASKED = """(SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'c_acctbal' WHEN 'error' THEN 'c_acctbal' WHEN 'click' THEN 'c_name'
    WHEN 'purchase' THEN 'nothing' END AS attribute FROM events)"""


@query(
    "term_problems",
    f"""SELECT event_id AS request_id, attribute AS "column", CASE event_type WHEN 'error' THEN 'is not a number'
          WHEN 'purchase' THEN 'names an attribute that is not there' ELSE 'names no attribute' END AS problem
        FROM {_ASKED} WHERE event_type NOT IN ('view', 'click')""",
)
def term_problems(spark, sf):
    """Events as search requests on customers, and why some can't be answered."""
    e = F.col("event_type")
    column = F.when(e.isin("view", "error"), "c_acctbal").when(e == "click", "c_name").when(e == "purchase", "nothing")
    value = F.when(e == "error", F.concat(F.lit("about "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    requests = raw(spark, sf, "events").select(F.col("event_id").alias("request_id"), column.alias("column"), value.alias("value"))
    return Q.term_problems(records(spark, sf, "customer"), requests)


@query(
    "key_problems",
    """SELECT event_id AS upload_id, CASE event_type WHEN 'view' THEN 'customer' ELSE 'part' END AS record_type,
              CASE event_type WHEN 'view' THEN 'the primary key is c_custkey, not p_partkey' ELSE 'the primary key is p_partkey, not c_custkey' END AS problem
       FROM events WHERE (event_type = 'view' AND event_id % 2 = 0) OR (event_type = 'click' AND event_id % 2 = 1)""",
)
def key_problems(spark, sf):
    """Events as uploads to customers, parts and new types, and which of them name another key than there is."""
    e = F.col("event_type")
    kind = F.when(e == "view", "customer").when(e == "click", "part").otherwise(e)
    key = F.when(F.col("event_id") % 2 == 0, "p_partkey").otherwise("c_custkey")
    uploads = raw(spark, sf, "events").select(F.col("event_id").alias("upload_id"), kind.alias("record_type"), key.alias("primary_key"))
    return Q.key_problems(star(spark, sf), uploads, ["customer", "part"])
