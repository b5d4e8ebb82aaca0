"""The conversion matrix on single values, hand-worked."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.errors import UnsupportedConversion
from recordloom.functions.convert import convert, is_supported
from recordloom.functions.jsontext import number_text
from recordloom.model import AttributeType as A

D = Decimal
DAY, STAMP = dt.date(2024, 8, 13), dt.datetime(2024, 8, 13, 19, 0, 0, 500000)

CASES = [
    ("'12.50'", A.STRING, A.NUMBER, D("12.5")), ("' -3 '", A.STRING, A.NUMBER, D(-3)), ("'1e3'", A.STRING, A.NUMBER, D(1000)),
    ("'on'", A.STRING, A.BOOLEAN, True), ("'OFF'", A.STRING, A.BOOLEAN, False), ("'tr'", A.STRING, A.BOOLEAN, True),
    ("' 0 '", A.STRING, A.BOOLEAN, False), ("'2024-08-13'", A.STRING, A.DATE, DAY),
    ("'2024-08-13T19:00:00.5'", A.STRING, A.DATE_TIME, STAMP), ("'2024-08-13 19:00:00.5+00'", A.STRING, A.DATE_TIME, STAMP),
    ("12.500", A.NUMBER, A.STRING, "12.5"), ("100", A.NUMBER, A.STRING, "100"), ("0", A.NUMBER, A.STRING, "0"),
    ("0.4", A.NUMBER, A.BOOLEAN, False), ("0.5", A.NUMBER, A.BOOLEAN, True), ("-2", A.NUMBER, A.BOOLEAN, True),
    ("1723575600.5", A.NUMBER, A.DATE_TIME, STAMP), ("1723575600.5", A.NUMBER, A.DATE, DAY), ("-1", A.NUMBER, A.DATE, dt.date(1969, 12, 31)),
    ("true", A.BOOLEAN, A.NUMBER, D(1)), ("false", A.BOOLEAN, A.STRING, "false"),
    ("date'2024-08-13'", A.DATE, A.NUMBER, D(1723507200)), ("date'2024-08-13'", A.DATE, A.DATE_TIME, dt.datetime(2024, 8, 13)),
    ("date'2024-08-13'", A.DATE, A.STRING, "2024-08-13"),
    ("timestamp_ntz'2024-08-13 19:00:00.5'", A.DATE_TIME, A.NUMBER, D("1723575600.5")),
    ("timestamp_ntz'1969-12-31 23:59:59.25'", A.DATE_TIME, A.NUMBER, D("-0.75")),
    ("timestamp_ntz'2024-08-13 19:00:00.5'", A.DATE_TIME, A.DATE, DAY),
    ("timestamp_ntz'2024-08-13 19:00:00'", A.DATE_TIME, A.STRING, "2024-08-13 19:00:00+00"),
    ("'x'", A.STRING, A.ARRAY_OF_STRING, ["x"]), ("cast(null as string)", A.STRING, A.ARRAY_OF_NUMBER, [None]),
    ("array('1', null, '2.5')", A.ARRAY_OF_STRING, A.ARRAY_OF_NUMBER, [D(1), None, D("2.5")]),
    ("array(true)", A.ARRAY_OF_BOOLEAN, A.ARRAY_OF_NUMBER, [D(1)]), ("array()", A.ARRAY_OF_NUMBER, A.ARRAY_OF_DATE_TIME, []),
    ("array(date'2024-08-13')", A.ARRAY_OF_DATE, A.ARRAY_OF_NUMBER, [D(1723507200)]),
    ("cast(null as double)", A.NUMBER, A.DATE_TIME, None), ("cast(null as array<double>)", A.ARRAY_OF_NUMBER, A.ARRAY_OF_STRING, None),
]


@pytest.mark.parametrize("sql,source,target,want", CASES)
def test_conversion(spark, sql, source, target, want):
    got = spark.range(1).select(convert(F.expr(sql), source, target).alias("v")).first()["v"]
    assert got == want


@pytest.mark.parametrize(
    "sql,target",
    [("'x'", A.NUMBER), ("'maybe'", A.BOOLEAN), ("'o'", A.BOOLEAN), ("''", A.BOOLEAN), ("'2021-02-30'", A.DATE), ("'soon'", A.DATE_TIME)],
)
def test_bad_value_fails_the_job(spark, sql, target):
    with pytest.raises(Exception, match="not a"):
        spark.range(1).select(convert(F.expr(sql), A.STRING, target).alias("v")).collect()


def test_supported_pairs():
    allowed = {
        (A.STRING, A.NUMBER), (A.STRING, A.BOOLEAN), (A.STRING, A.DATE), (A.STRING, A.DATE_TIME),
        (A.NUMBER, A.BOOLEAN), (A.NUMBER, A.DATE), (A.NUMBER, A.DATE_TIME), (A.DATE, A.DATE_TIME),
    }
    bases = [t for t in A if not t.is_array and t is not A.NULL]
    for s in bases:
        for t in bases:
            want = s is t or (s, t) in allowed or (t, s) in allowed
            assert is_supported(s, t) is want and is_supported(s.array, t.array) is want
            assert is_supported(s, t.array) is want and is_supported(s.array, t) is False
    with pytest.raises(UnsupportedConversion):
        convert(F.lit(1), A.BOOLEAN, A.DATE)


@pytest.mark.parametrize("text", ["0.1234567890123456789012", "1e-20", "1e25", "12.5E-18"])
def test_numbers_are_refused_rather_than_rounded(spark, text):
    df = spark.createDataFrame([(text,)], "v string")
    with pytest.raises(Exception, match="not a NUMBER"):
        df.select(convert(F.col("v"), A.STRING, A.NUMBER)).collect()


def test_number_text_keeps_every_digit(spark):
    rows = spark.sql("SELECT * FROM VALUES (1e-20D), (1e25D), (0.1D), (2.50D), (0D), (-1234567.125D) AS t(v)")
    texts = [r[0] for r in rows.select(number_text(F.col("v"))).collect()]
    assert [float(t) for t in texts] == [1e-20, 1e25, 0.1, 2.5, 0.0, -1234567.125]
    assert texts[2:5] == ["0.1", "2.5", "0"]
    exact = spark.createDataFrame([("0.000000000000000001",), ("1.25e3",), ("10.000",)], "v string")
    assert [str(r[0].normalize()) for r in exact.select(convert(F.col("v"), A.STRING, A.NUMBER)).collect()] == ["1E-18", "1.25E+3", "1E+1"]


def test_numbers_are_exact_to_18_places(spark):
    from recordloom.functions.convert import _is_exact

    exact = {
        "0.123456789012345678": True, "0.1234567890123456789": False, "0.1234567890123456780": True, "1e-18": True, "1E-19": False,
        ".123456789012345678": True, "12345678901234567890": True, "1.5e3": True, "1.23456789012345678901e2": True, "-0.5": True,
    }
    rows = spark.createDataFrame([(t,) for t in exact], "t string")
    assert {r["t"]: r["x"] for r in rows.withColumn("x", _is_exact(rows["t"])).collect()} == exact
