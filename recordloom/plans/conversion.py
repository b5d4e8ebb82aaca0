"""The conversion matrix, a query per pair of types, over whole columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.convert import convert
from recordloom.model import AttributeType as A
from recordloom.model import tag
from recordloom.operators.evolve import convert_attribute
from recordloom.plans.registry import query
from recordloom.plans.star import records

_SPELLED = {"F": " yes ", "O": "oF", "P": "TRU"}


def _register(name: str, table: str, key: str, value, source: A, target: A, sql: str, show=None):
    """A query converting ``value()`` of every record; ``show`` makes the result comparable."""

    @query(name, f"SELECT CAST({key} AS VARCHAR) AS id, {sql} AS result FROM {table}")
    def run(spark, sf):
        rows = records(spark, sf, table)
        df = rows.df.select(F.col(key), value().alias("value"))
        changed = convert_attribute(rows.with_df(tag(df, key, {"value": source})), "value", target).df
        result = F.col("value")
        return changed.select(F.col(key).alias("id"), (show(result) if show else result).alias("result"))


def _double(c: Column) -> Column:
    return c.cast("double")


def _string(c: Column) -> Column:
    return c.cast("string")


def _day() -> Column:
    return F.col("o_orderdate").cast("date")


def _spelled() -> Column:
    spelling = F.create_map(*[F.lit(x) for p in _SPELLED.items() for x in p])
    return spelling[F.col("o_orderstatus")]


_SQL_NUMBER = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')"

_register("convert_string_number", "orders", "o_orderkey", lambda: F.concat(F.lit(" "), F.col("o_totalprice").cast("string")),
          A.STRING, A.NUMBER, "o_totalprice", _double)
_register("convert_string_boolean", "orders", "o_orderkey", lambda: _spelled(),
          A.STRING, A.BOOLEAN, "o_orderstatus <> 'O'")
_register("convert_string_date", "orders", "o_orderkey", lambda: F.date_format("o_orderdate", "yyyy-MM-dd"),
          A.STRING, A.DATE, "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", _string)
_register("convert_string_datetime", "events", "event_id", lambda: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
          A.STRING, A.DATE_TIME, "CAST(ts AS VARCHAR)", _string)
_register("convert_number_string", "orders", "o_orderkey", lambda: F.col("o_totalprice").cast("decimal(38,18)"),
          A.NUMBER, A.STRING, _SQL_NUMBER.format("o_totalprice"))
_register("convert_number_boolean", "part", "p_partkey",
          lambda: (F.col("p_size") - 25) / 4, A.NUMBER, A.BOOLEAN, "abs((p_size - 25) / 4.0) >= 0.5")
_register("convert_number_date", "orders", "o_orderkey", lambda: F.col("o_totalprice") * 1000,
          A.NUMBER, A.DATE, "CAST(CAST(make_timestamp(CAST(round(o_totalprice * 1000 * 1000000) AS BIGINT)) AS DATE) AS VARCHAR)", _string)
_register("convert_number_datetime", "orders", "o_orderkey", lambda: F.col("o_totalprice"),
          A.NUMBER, A.DATE_TIME, "CAST(make_timestamp(CAST(round(o_totalprice * 1000000) AS BIGINT)) AS VARCHAR)", _string)
_register("convert_boolean_number", "documents", "doc_id", lambda: F.col("n_chars") > 1000,
          A.BOOLEAN, A.NUMBER, "CAST(n_chars > 1000 AS DOUBLE)", _double)
_register("convert_boolean_string", "documents", "doc_id", lambda: F.col("n_chars") > 1000,
          A.BOOLEAN, A.STRING, "CAST(n_chars > 1000 AS VARCHAR)")
_register("convert_date_number", "orders", "o_orderkey", lambda: _day(),
          A.DATE, A.NUMBER, "CAST(epoch(CAST(o_orderdate AS DATE)) AS DOUBLE)", _double)
_register("convert_date_datetime", "orders", "o_orderkey", lambda: _day(), A.DATE, A.DATE_TIME, "CAST(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS VARCHAR)", _string)
_register("convert_date_string", "orders", "o_orderkey", lambda: _day(), A.DATE, A.STRING, "strftime(o_orderdate, '%Y-%m-%d')")
_register("convert_datetime_number", "events", "event_id", lambda: F.col("ts"),
          A.DATE_TIME, A.NUMBER, "CAST(epoch_us(ts) AS VARCHAR)",
          lambda c: (c.cast("decimal(38,6)") * 1_000_000).cast("decimal(20,0)").cast("string"))
_register("convert_datetime_date", "events", "event_id", lambda: F.col("ts"),
          A.DATE_TIME, A.DATE, "CAST(CAST(ts AS DATE) AS VARCHAR)", _string)
_register("convert_datetime_string", "orders", "o_orderkey", lambda: F.col("o_orderdate"),
          A.DATE_TIME, A.STRING, "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00'")
_register("convert_scalar_array", "events", "event_id", lambda: F.when(F.col("event_type") != "view", F.col("value")),
          A.NUMBER, A.ARRAY_OF_STRING,
          "'[' || CASE event_type WHEN 'view' THEN 'null' ELSE " + _SQL_NUMBER.format("value") + " END || ']'",
          lambda c: F.concat(F.lit("["), F.array_join(c, ",", "null"), F.lit("]")))
_register("convert_array_number_string", "events", "event_id", lambda: F.array("value", F.col("user_id").cast("double")),
          A.ARRAY_OF_NUMBER, A.ARRAY_OF_STRING, _SQL_NUMBER.format("value") + " || ',' || user_id",
          lambda c: F.array_join(c, ","))
_register("convert_array_string_number", "events", "event_id",
          lambda: F.array(F.col("value").cast("string"), F.lit(None).cast("string")), A.ARRAY_OF_STRING, A.ARRAY_OF_NUMBER,
          "value", lambda c: F.aggregate(F.array_compact(c), F.lit(0.0), lambda a, x: a + x.cast("double")))
_register("convert_array_number_datetime", "orders", "o_orderkey", lambda: F.array("o_totalprice"),
          A.ARRAY_OF_NUMBER, A.ARRAY_OF_DATE_TIME,
          "CAST(make_timestamp(CAST(round(o_totalprice * 1000000) AS BIGINT)) AS VARCHAR)",
          lambda c: F.get(c, 0).cast("string"))
_register("convert_array_datetime_number", "orders", "o_orderkey", lambda: F.array("o_orderdate", F.lit(None).cast("timestamp_ntz")),
          A.ARRAY_OF_DATE_TIME, A.ARRAY_OF_NUMBER, "CAST(epoch(o_orderdate) AS DOUBLE)", lambda c: F.get(c, 0).cast("double"))
_register("convert_array_date_datetime", "orders", "o_orderkey", lambda: F.array(_day()), A.ARRAY_OF_DATE, A.ARRAY_OF_DATE_TIME,
          "CAST(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS VARCHAR)", lambda c: F.get(c, 0).cast("string"))
_register("convert_array_boolean_number", "documents", "doc_id", lambda: F.array(F.col("n_chars") > 1000), A.ARRAY_OF_BOOLEAN,
          A.ARRAY_OF_NUMBER, "CAST(n_chars > 1000 AS DOUBLE)", lambda c: F.get(c, 0).cast("double"))


@query(
    "convert_text_columns",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, CAST(o_orderdate AS VARCHAR) AS placed, o_orderstatus <> 'O' AS done
       FROM orders""",
)
def convert_text_columns(spark, sf):
    """Several columns of one table converted in one projection."""
    orders = records(spark, sf, "orders").df
    return orders.select(
        F.col("o_orderkey").alias("id"),
        convert(F.col("o_totalprice").cast("string"), A.STRING, A.NUMBER).cast("double").alias("price"),
        convert(F.col("o_orderdate").cast("string"), A.STRING, A.DATE_TIME).cast("string").alias("placed"),
        convert(_spelled(), A.STRING, A.BOOLEAN).alias("done"),
    )
