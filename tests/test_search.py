"""Terms, sorting and paging on small hand-made tables."""

import random
import time

import pytest
from pyspark.sql import functions as F
from recordloom.constants import RELATION_SCHEME
from recordloom.errors import InvalidQuery
from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable, tag
from recordloom.operators import search as S

URI = f"{RELATION_SCHEME}/test/"


@pytest.fixture(scope="module")
def table(spark):
    df = spark.sql(
        f"""SELECT * FROM VALUES
        ('1', 'Hello World', array('Hello', 'World'), -1.23, array(31, 41, 59), true, array(true, false),
         date'1979-06-25', array(date'1971-11-12'), timestamp_ntz'2024-08-13 19:00:00', array(timestamp_ntz'2024-08-13 19:00:00'),
         'drs://example.org/1', '{{"foo":12,"bar":[1]}}', array('{{"foo":1}}'), '1', array('{URI}A', '{URI}b')),
        ('2', 'embedded "quotes"', array('100%', 'a_c'), 40.0, array(27), false, array(false),
         date'2000-01-01', array(date'2000-01-01'), timestamp_ntz'2000-01-01 00:00:00', array(timestamp_ntz'2000-01-01 00:00:00'),
         'drs://example.org/2', '{{"bar":[1.0],"foo":12.0}}', array('{{"foo":2}}'), '2', array('{URI}c')),
        ('3', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(id, str, arrstr, num, arrnum, bool, arrbool, date, arrdate, datetime, arrdatetime, file, json, arrjson, rel, arrrel)"""
    )
    kinds = {"file": A.FILE, "json": A.JSON, "arrjson": A.ARRAY_OF_JSON}
    return RecordTable("test", tag(df, "id", kinds, {"rel": "test", "arrrel": "test"}), "id")


TERMS = [
    ("str", "hello world", "1"), ("str", "hello*", ""), ("str", 'EMBEDDED "quotes"', "2"), ("arrstr", "HELLO", "1"),
    ("arrstr", "100 bottles", "2"), ("arrstr", "abc", "2"), ("arrstr", "he%", ""), ("num", "-1.23", "1"), ("num", 40, "2"),
    ("arrnum", "41", "1"), ("bool", "FALSE", "2"), ("arrbool", True, "1"), ("arrbool", "false", "12"),
    ("date", "1979-06-25", "1"), ("arrdate", "2000-01-01", "2"), ("datetime", "2024-08-13T19:00:00", "1"),
    ("arrdatetime", "2000-01-01T00:00:00", "2"), ("file", "DRS://example.org/2", "2"), ("json", '{"foo":12, "bar":[1]}', "12"),
    ("json", '{"foo":12}', ""), ("arrjson", '{"foo": 1.0}', "1"), ("rel", "2", "2"), ("arrrel", "B", "1"), ("arrrel", "C", "2"),
]


@pytest.mark.parametrize("column,value,want", TERMS)
def test_term(table, column, value, want):
    found = table.df.filter(S.term(table, column, value)).select("id").collect()
    assert "".join(sorted(r["id"] for r in found)) == want


@pytest.mark.parametrize(
    "column,value",
    [("nope", "x"), ("num", "x"), ("bool", "yes"), ("date", "01/02/2003"), ("datetime", "2003-02-01T25:00:00"),
     ("datetime", "2003-02-01T10:00:00Z"), ("json", 5)],
)
def test_bad_terms(table, column, value):
    with pytest.raises(InvalidQuery):
        S.term(table, column, value)


def test_pattern_with_backslash_before_ordinary_character(spark):
    df = spark.createDataFrame([("1", [r"a\bc"])], "id string, words array<string>")
    t = RecordTable("t", df, "id")
    assert df.filter(S.term(t, "words", "ABC")).count() == 1


def test_empty_ids_match_nothing(table):
    assert S.search(table, ids=[]).count() == 0
    assert S.search(table, ids=["1", "3", "9"], sort="str").count() == 2
    many = [str(i) for i in range(3, S.INLINE_IDS + 50)]
    assert [r["id"] for r in S.filter_ids(table, many).collect()] == ["3"]


def test_null_order(table):
    up = [r["id"] for r in S.search(table, sort="num").collect()]
    down = [r["id"] for r in S.search(table, sort="num", descending=True).collect()]
    assert (up, down) == (["1", "2", "3"], ["3", "2", "1"])


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 1001}, {"offset": -1}, {"sort": "nope"}])
def test_bad_pages(table, bad):
    with pytest.raises(InvalidQuery):
        S.search(table, **bad)


def test_total_is_unfiltered_and_offset_past_end_is_empty(table):
    rows = S.search_with_total(table, where=("num", 40)).collect()
    assert [(r["id"], r["total_records"]) for r in rows] == [("2", 3)]
    assert S.search_with_total(table, offset=4).count() == 0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("offset", [150, 1234, 2500, 4995])
def test_deep_page_equals_plain_sort(spark, descending, offset):
    """A third of the rows share one sort value, and some have none."""
    rng = random.Random(3)
    values = [7 if i % 3 == 0 else (None if i % 11 == 0 else rng.randint(0, 50)) for i in range(5000)]
    rows = [(f"{i:05d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id string, v int").repartition(8)
    t = RecordTable("t", df, "id")
    got = S.page(t, df, "v", descending, limit=20, offset=offset, deep_offset=100).collect()

    def key(r):
        if descending:
            return (r[1] is not None, -(r[1] or 0), r[0])
        return (r[1] is None, r[1] or 0, r[0])

    want = sorted(rows, key=key)[offset : offset + 20]
    assert [tuple(r) for r in got] == want


def test_record_exists(spark, table):
    ids = spark.createDataFrame([("1",), ("9",), ("1",)], "record_id string")
    found = {r["record_id"]: r["found"] for r in S.records_exist(table, ids).collect()}
    assert found == {"1": True, "9": False}


def test_read_records_gives_uris(table):
    row = S.read_records(table).filter("id = '1'").first()
    assert row["rel"] == f"{URI}1" and list(row.asDict())[0] == "id"
    assert S.read_records(table).filter("id = '3'").first()["rel"] is None


def test_filter_reaches_the_scan(spark, sf, capsys):
    df = spark.read.parquet(f"{sf}/part.parquet")
    t = RecordTable("part", df, "p_partkey")
    S.search(t, where=("p_brand", "Brand#1")).select("p_partkey").explain()
    t.df.filter(S.term(t, "p_retailprice", 900)).select("p_partkey").explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(p_retailprice,900.0)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan


def test_date_time_terms_do_not_depend_on_the_drivers_zone(spark, monkeypatch):
    df = spark.sql("SELECT '1' AS id, timestamp_ntz'2024-03-10 02:30:00' AS at UNION ALL SELECT '2', timestamp_ntz'2024-07-01 12:00:00'")
    table = RecordTable("t", tag(df, "id"), "id")
    try:
        monkeypatch.setenv("TZ", "America/New_York")
        time.tzset()
        for rid, text in (("1", "2024-03-10T02:30:00"), ("2", "2024-07-01T12:00:00")):
            assert [r["id"] for r in df.filter(S.term(table, "at", text)).collect()] == [rid]
    finally:
        monkeypatch.undo()
        time.tzset()


def test_ids_select_by_the_stored_key(spark, sf):
    from recordloom.plans.star import records
    from recordloom.operators.search import filter_ids, get_record

    plan = lambda df: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    customers = records(spark, sf, "customer")
    assert "PushedFilters: [In(c_custkey, [37,42])]" in plan(filter_ids(customers, ["42", "37"]))
    assert "EqualTo(c_custkey,42)" in plan(get_record(customers, "42"))
    every = {r["c_custkey"] for r in customers.df.collect()}
    # texts that are no key's own text, and numbers that no key can be
    odd = ["042", "+42", " 42", "4.2e1", "42", "-0", "", "x", "\u0664", "9" * 19, "9" * 30, "7"]
    assert {r["c_custkey"] for r in filter_ids(customers, odd).collect()} == {"42", "7"} & every
    frame = spark.createDataFrame([(i,) for i in [*odd, None]], "record_id string")
    assert {r["c_custkey"] for r in filter_ids(customers, frame).collect()} == {"42", "7"} & every
    many = [str(i) for i in range(0, 1000)]
    assert {r["c_custkey"] for r in filter_ids(customers, many).collect()} == set(many) & every
    assert filter_ids(customers, ["x"]).collect() == [] and get_record(customers, "nothing").collect() == []
    nation = records(spark, sf, "nation")
    assert [r["n_nationkey"] for r in filter_ids(nation, ["3", str(1 << 33)]).collect()] == ["3"]


def test_requests_are_refused_as_single_terms_are(spark):
    """Every request has a problem if and only if its term can't be made."""
    from recordloom.operators.requests import key_problems, term_problems
    from recordloom.operators.search import term

    fields = {"s": "string", "n": "decimal(38,18)", "b": "boolean", "d": "date", "t": "timestamp_ntz", "j": "string", "ns": "array<decimal(38,18)>"}
    table = RecordTable("t", tag(spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in fields.items())), "s", {"j": A.JSON}), "s")
    values = ["x", "", "1", "-1.5e3", ".5", "5.", "1e", "true", "FALSE", "2020-02-29", "2021-02-29", "2020-2-9", "2020-01-01T10:00:00",
              "2020-01-01 10:00:00.25", "2020-01-01T25:00:00", '{"a": [1]}', "{a}", "null"]
    rows = [(f"{c}/{v}", c, v) for c in [*fields, "gone"] for v in values if (c, v) != ("t", "2020-02-29")] + [("none", None, "x"), ("empty", "", "x"), ("no value", "n", None)]
    requests = spark.createDataFrame(rows, "request_id string, column string, value string")
    found = {r["request_id"]: r["problem"] for r in term_problems(table, requests).collect()}
    for rid, column, value in rows:
        try:
            # a JSON term is only parsed where it is compared
            refused = column in (None, "") or value is None or (column == "j" and not spark.range(1).select(F.try_parse_json(F.lit(value)).isNotNull()).first()[0])
            if not refused:
                term(table, column, value)
        except InvalidQuery:
            refused = True
        assert (rid in found) == refused, rid
    tables = Collection.of(table)
    uploads = spark.createDataFrame([(1, "t", "s"), (2, "t", "n"), (3, "new", "n"), (4, "t", None), (5, None, "x")], "upload_id long, record_type string, primary_key string")
    assert [(r["upload_id"], r["problem"]) for r in key_problems(tables, uploads, ["t"]).collect()] == [(2, "the primary key is s, not n")]
    assert key_problems(tables, uploads, []).collect() == []
