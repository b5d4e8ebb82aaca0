"""Recognisers, type inference and relation detection over cells of the tables.

The cells come from ``events``: what a cell spells depends on its event type, so
every scalar and array type occurs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME
from recordloom.functions import infer
from recordloom.functions import recognise as R
from recordloom.functions.relation import relation_id, relation_type, relation_uri
from recordloom.model import AttributeType as A
from recordloom.operators.inference import infer_columns, relation_targets, summarise_columns
from recordloom.operators.integrity import type_mismatches
from recordloom.plans.importing import scratch
from recordloom.plans.registry import query
from recordloom.plans.star import raw, records
from recordloom.sinks.summary import keep_summary


def by_event(**cells: Column) -> Column:
    """One cell per row, spelled as its event type says."""
    chosen = F.lit(None).cast("string")
    for event, cell in cells.items():
        chosen = F.when(F.col("event_type") == event, cell).otherwise(chosen)
    return chosen


def _day(c="ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _iso(c="ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def tsv_cells(df, *more):
    """Text cells of many types, one column per mixture, and ``more`` columns beside them."""
    value = F.col("value").cast("string")
    k = F.get_json_object("props", "$.k")
    uri = relation_uri("user", F.col("user_id").cast("string"))
    return df.select(
        "event_id",
        by_event(view=value, click=F.col("props"), signup=_day(), purchase=_iso(), error=F.lit("TRUE")).alias("mixed"),
        by_event(view=uri, click=F.concat(F.lit("drs://files.example.org/"), k),
                 signup=F.concat(F.lit('"'), value, F.lit('"')), purchase=F.col("event_type"), error=F.lit("")).alias("named"),
        by_event(
            view=F.concat(F.lit("["), value, F.lit(", "), k, F.lit("]")),
            click=F.concat(F.lit("[“"), _day(), F.lit("”, “"), _iso(), F.lit("”]")),
            signup=F.lit("[TRUE, false]"), purchase=F.lit("[]"),
            error=F.concat(F.lit("["), F.col("props"), F.lit(", 1]")),
        ).alias("listed"),
        by_event(
            view=F.concat(F.lit('["'), uri, F.lit('", null]')), click=F.lit("[null]"),
            signup=F.concat(F.lit('["'), _iso(), F.lit('", "'), _day(), F.lit('"]')),
            purchase=F.concat(F.lit('["'), _day(), F.lit('", "'), _day(), F.lit('"]')),
            error=F.concat(F.lit('[1, "'), F.col("event_type"), F.lit('"]')),
        ).alias("more"),
        F.col("event_type"),
        *more,
    )


_TSV_TYPES = {
    "mixed": {"view": "NUMBER", "click": "JSON", "signup": "DATE", "purchase": "DATE_TIME", "error": "BOOLEAN"},
    "named": {"view": "RELATION", "click": "FILE", "signup": "STRING", "purchase": "STRING", "error": "NULL"},
    "listed": {"view": "ARRAY_OF_NUMBER", "click": "ARRAY_OF_DATE_TIME", "signup": "ARRAY_OF_BOOLEAN",
               "purchase": "EMPTY_ARRAY", "error": "ARRAY_OF_JSON"},
    "more": {"view": "ARRAY_OF_RELATION", "click": "ARRAY_OF_STRING", "signup": "ARRAY_OF_STRING",
             "purchase": "ARRAY_OF_DATE", "error": "ARRAY_OF_STRING"},
}


def _case(names: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(
    "tsv_infer",
    "SELECT event_id, " + ", ".join(f"{_case(m)} AS {n}" for n, m in _TSV_TYPES.items()) + " FROM events",
)
def tsv_infer(spark, sf):
    cells = tsv_cells(raw(spark, sf, "events"))
    return cells.select("event_id", *[infer.tsv_type(n).alias(n) for n in _TSV_TYPES])


@query(
    "infer_cell",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'NUMBER' WHEN 'click' THEN 'JSON' WHEN 'signup' THEN 'STRING'
         WHEN 'purchase' THEN 'DATE_TIME' ELSE 'BOOLEAN' END AS a,
         CASE event_type WHEN 'view' THEN 'STRING' WHEN 'click' THEN 'RELATION' WHEN 'signup' THEN 'NULL'
         WHEN 'purchase' THEN 'DATE' ELSE 'BOOLEAN' END AS b FROM events""",
)
def infer_cell(spark, sf):
    """JSON values: a number in quotes stays text, dates in quotes are dates."""
    value = F.col("value").cast("string")

    def quote(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    uri = relation_uri("user", F.col("user_id").cast("string"))
    a = by_event(view=value, click=F.col("props"), signup=quote(value), purchase=quote(_iso()), error=F.lit("true"))
    b = by_event(view=quote(F.concat(value, F.lit("e"))), click=quote(uri), signup=F.lit("null"),
                 purchase=quote(_day()), error=F.lit('"tRue"'))
    events = raw(spark, sf, "events")
    return events.select(
        "event_id", *[infer.json_type(F.parse_json(c)).alias(n) for n, c in (("a", a), ("b", b))]
    )


# what the fold over arrival order comes to, per column
_FOLD = """SELECT '{0}' AS attribute, CASE
    WHEN len(t) = 0 THEN 'NULL' WHEN len(t) = 1 THEN t[1]
    WHEN t = ['DATE', 'DATE_TIME'] AND d < s THEN 'DATE_TIME'
    WHEN len([x for x in t if NOT (x LIKE 'ARRAY_OF%' OR x = 'EMPTY_ARRAY')]) > 0 THEN 'STRING'
    WHEN len([x for x in t if x <> 'EMPTY_ARRAY']) = 1 THEN [x for x in t if x <> 'EMPTY_ARRAY'][1]
    ELSE 'ARRAY_OF_STRING' END AS attribute_type
  FROM (SELECT list_sort(list_distinct(list(k) FILTER (k <> 'NULL'))) t, max(event_id) FILTER (k = 'DATE') d,
               min(event_id) FILTER (k = 'DATE_TIME') s
        FROM (SELECT event_id, {1} AS k FROM events))"""

_SPLIT = "(SELECT (min(event_id) + max(event_id)) / 2 FROM events)"


_COLUMNS_SQL = " UNION ALL ".join(
    [_FOLD.format(n, _case(m)) for n, m in _TSV_TYPES.items()]
    + [
        _FOLD.format("widened", f"CASE WHEN event_id <= {_SPLIT} THEN 'DATE' ELSE 'DATE_TIME' END"),
        _FOLD.format("narrowed", f"CASE WHEN event_id <= {_SPLIT} THEN 'DATE_TIME' ELSE 'DATE' END"),
        _FOLD.format("numbers", "CASE event_type WHEN 'error' THEN 'NULL' ELSE 'NUMBER' END"),
        _FOLD.format("lists", "CASE event_type WHEN 'error' THEN 'EMPTY_ARRAY' ELSE 'ARRAY_OF_NUMBER' END"),
        _FOLD.format("both", "CASE event_type WHEN 'error' THEN 'NUMBER' ELSE 'ARRAY_OF_NUMBER' END"),
    ]
)
_MIXED = [*_TSV_TYPES, "widened", "narrowed", "numbers", "lists", "both"]


def _mixed_cells(spark, sf):
    events = raw(spark, sf, "events")
    half = sum(events.agg(F.min("event_id"), F.max("event_id")).first()) / 2
    # typing costs far more than reading: rows are dealt to all tasks, however few parts the files (or the upload's share of them) have
    events = events.repartition(2 * spark.sparkContext.defaultParallelism, "event_id")
    early, failed, listed = F.col("event_id") <= half, F.col("event_type") == "error", F.concat(F.lit("["), "value", F.lit("]"))
    return tsv_cells(
        events,
        F.when(early, _day()).otherwise(_iso()).alias("widened"),
        F.when(early, _iso()).otherwise(_day()).alias("narrowed"),
        F.when(~failed, F.col("value").cast("string")).alias("numbers"),
        F.when(failed, "[]").otherwise(listed).alias("lists"),
        F.when(failed, F.col("value").cast("string")).otherwise(listed).alias("both"),
    )


@query("infer_column", _COLUMNS_SQL)
def infer_column(spark, sf):
    return infer_columns(_mixed_cells(spark, sf), {n: infer.tsv_type(n) for n in _MIXED}, F.col("event_id"))


@query("infer_pieces", _COLUMNS_SQL)
def infer_pieces(spark, sf):
    """The same from three uploads, of which only summaries are kept and merged, the last one first."""
    cells, path = _mixed_cells(spark, sf), scratch(spark, "uploads")
    low, high = raw(spark, sf, "events").agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [low, low + (high - low) // 3, low + (high - low) * 2 // 3, high + 1]
    types = {}
    for version, upload in enumerate((2, 0, 1)):
        piece = cells.where((F.col("event_id") >= cuts[upload]) & (F.col("event_id") < cuts[upload + 1]))
        summary = summarise_columns(piece, {n: infer.tsv_type(n) for n in _MIXED}, F.col("event_id") - cuts[upload], upload)
        types = keep_summary(summary, path, version)
    return spark.createDataFrame([(n, k.value) for n, k in types.items()], "attribute string, attribute_type string")


@query(
    "infer_array",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'ARRAY_OF_NUMBER' WHEN 'click' THEN 'ARRAY_OF_DATE_TIME'
         WHEN 'signup' THEN 'ARRAY_OF_JSON' WHEN 'purchase' THEN 'ARRAY_OF_BOOLEAN' ELSE 'ARRAY_OF_STRING' END AS kind
       FROM events""",
)
def infer_array(spark, sf):
    value, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")

    def listed(*parts):
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    def quote(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    text = by_event(
        view=listed(value, F.lit("null"), k),
        click=listed(quote(_day()), F.lit("null"), quote(_iso()), quote(_day())),
        signup=listed(F.lit("[1]"), value),
        purchase=listed(F.lit("true"), F.lit('"False"')),
        error=listed(quote(_iso()), quote(_day())),
    )
    return raw(spark, sf, "events").select("event_id", infer.array_type(F.parse_json(text)).alias("kind"))


_TOKENS = r"(SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM documents)"
_SQL_DATE = r"regexp_full_match(w, '\d{4}-\d{2}-\d{2}') AND TRY_CAST(w AS DATE) IS NOT NULL"


@query(
    "recognisers",
    rf"""SELECT boolean, number, date, date_time, file, count(*) AS tokens FROM (
          SELECT lower(w) IN ('true', 'false') AS boolean,
            regexp_full_match(w, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AS number,
            {_SQL_DATE} AS date,
            regexp_full_match(w, '\d{{4}}-\d{{2}}-\d{{2}}[Tt]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,9}})?)?')
              AND TRY_CAST(w AS TIMESTAMP) IS NOT NULL AS date_time,
            regexp_matches(w, '^(?i)drs://[a-z0-9]') AS file FROM {_TOKENS})
        GROUP BY ALL""",
)
def recognisers(spark, sf):
    """Every token of every document, counted by what it could be."""
    words = raw(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("w"))
    w = "w"
    flags = words.select(
        R.is_boolean(w).alias("boolean"), R.is_number(w).alias("number"), R.is_date(w).alias("date"),
        R.is_date_time(w).alias("date_time"), R.is_file(w).alias("file"),
    )
    return flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("tokens"))


@query(
    "recognise_dates",
    r"""SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, TRY_CAST(t AS DATE) IS NOT NULL AS date, false AS loose_date,
              TRY_CAST(t || 'T10:15' AS TIMESTAMP) IS NOT NULL AS date_time, false AS loose_date_time
       FROM (SELECT *, strftime(o_orderdate, '%Y-%m-') || CASE o_orderstatus WHEN 'P' THEN '31' ELSE strftime(o_orderdate, '%d') END AS t FROM orders)""",
)
def recognise_dates(spark, sf):
    """Days that may not exist, in strict and in loose spelling."""
    orders = records(spark, sf, "orders").df
    last = F.when(F.col("o_orderstatus") == "P", "31").otherwise(F.date_format("o_orderdate", "dd"))
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), last)
    loose = F.concat(F.date_format("o_orderdate", "yyyy-M-"), F.lit("1"))
    return orders.select(
        "o_orderkey", R.is_date(day).alias("date"), R.is_date(loose).alias("loose_date"),
        R.is_date_time(F.concat(day, F.lit("T10:15"))).alias("date_time"),
        R.is_date_time(F.concat(day, F.lit(" 10:15"))).alias("loose_date_time"),
    )


@query(
    "infer_file",
    """SELECT CAST(page_id AS VARCHAR) page_id, url LIKE 'http://%' AS drs,
              url LIKE 'https://%' AND split_part(split_part(url, '/', 3), ':', 1) LIKE '%.example.net' AS blob FROM pages""",
)
def infer_file(spark, sf):
    pages = records(spark, sf, "pages").df
    drs = F.regexp_replace("url", "^http://", "drs://")
    blob = F.replace(F.col("url"), F.lit("example.net"), F.lit("blob.core.windows.net"))
    return pages.select("page_id", R.is_file(drs).alias("drs"), R.is_file(blob).alias("blob"))


@query(
    "relation_parse",
    f"""SELECT '{RELATION_SCHEME}/customer/' || o_custkey AS uri, 'customer' AS kind,
               CAST(o_custkey AS VARCHAR) AS id, true AS is_relation, count(*) AS orders
        FROM orders GROUP BY ALL""",
)
def relation_parse(spark, sf):
    uri = relation_uri("customer", F.col("o_custkey"))
    parsed = records(spark, sf, "orders").df.select(uri.alias("uri"))
    c = F.col("uri")
    parsed = parsed.select(
        "uri", relation_type(c).alias("kind"), relation_id(c).alias("id"), c.startswith(RELATION_SCHEME).alias("is_relation")
    )
    return parsed.groupBy(*parsed.columns).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "relation_targets",
    """SELECT DISTINCT 'customer' AS attribute, 'customer' AS target FROM orders
       UNION ALL SELECT DISTINCT 'mixed', CASE o_orderstatus WHEN 'F' THEN 'part' ELSE 'supplier' END FROM orders
       UNION ALL SELECT DISTINCT 'listed', CASE o_orderstatus WHEN 'F' THEN NULL ELSE 'supplier' END FROM orders""",
)
def relation_targets_query(spark, sf):
    orders = records(spark, sf, "orders").df
    kind = F.when(F.col("o_orderstatus") == "F", "part").otherwise("supplier")
    supplier = relation_uri("supplier", F.col("o_custkey"))
    uris = orders.select(
        relation_uri("customer", F.col("o_custkey")).alias("customer"),
        relation_uri(kind, F.col("o_custkey")).alias("mixed"),
        F.array(relation_uri(kind, F.col("o_custkey")), supplier).alias("listed"),
    )
    return relation_targets(uris, {"customer": A.RELATION, "mixed": A.RELATION, "listed": A.ARRAY_OF_RELATION})


@query(
    "type_mismatch",
    f"""SELECT CAST(event_id AS VARCHAR) record_id, attribute, event_id || ': ' || k || ' given for ' || want || ' attribute ' || attribute || ' of event' AS message
        FROM (SELECT event_id, 'mixed' AS attribute, {_case(_TSV_TYPES["mixed"])} AS k, 'NUMBER' AS want FROM events
              UNION ALL SELECT event_id, 'listed', {_case(_TSV_TYPES["listed"])}, 'ARRAY_OF_NUMBER' FROM events)
        WHERE k <> want""",
)
def type_mismatch(spark, sf):
    cells = tsv_cells(raw(spark, sf, "events"))
    cells = cells.withColumn("event_id", F.col("event_id").cast("string"))
    kinds = {n: infer.tsv_type(n) for n in ("mixed", "listed")}
    schema = {"mixed": A.NUMBER, "listed": A.ARRAY_OF_NUMBER}
    return type_mismatches(cells, "event_id", "event", kinds, schema)
