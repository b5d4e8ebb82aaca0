"""TSV, operations, nested rows and manifests from small files."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.constants import MANIFEST_DEFAULT_KEY, RELATION_SCHEME
from recordloom.errors import InvalidName, InvalidTsv, MissingObject
from recordloom.model import AttributeType as A
from recordloom.sinks.export import tsv_cells, write_tsv
from recordloom.model import RecordTable
from recordloom.sources import manifest as M
from recordloom.sources import nested as N
from recordloom.sources import operations as O
from recordloom.sources import tsv as T
from recordloom.sources.places import with_place
from tests.conftest import collect

SMALL = (
    "sys_key\tgreeting\tunicode\tjson\tdate\tlong\tflags\tdays\tempty\n"
    'a\thello\t😀\t"{""a"":1}"\t2021-10-03\t5\t[TRUE,false]\t[“2021-10-03”]\t\n'
    'b\t"multi\nline\tcell"\té\t"{\\"a\\":2.50}"\t2021-10-04T01:02:03\t6.5\t[]\t["2021-10-04T00:00:00"]\t\n'
    "\n"
    "c\t\t\t\t\t\t\t\t\n"
)


def _file(tmp_path, text, name="in.tsv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv_end_to_end(spark, tmp_path):
    cells, key = T.read_tsv(spark, _file(tmp_path, SMALL), multi_line=True)
    assert key == "sys_key"
    kinds = T.infer_tsv(cells, key)
    assert kinds == {
        "greeting": A.STRING, "unicode": A.STRING, "json": A.JSON, "date": A.DATE_TIME, "long": A.NUMBER,
        "flags": A.ARRAY_OF_BOOLEAN, "days": A.ARRAY_OF_DATE_TIME, "empty": A.NULL,
    }
    rows = {r["sys_key"]: r.asDict() for r in T.load_tsv(cells, key).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert a["json"] == '{"a":1}' and a["date"] == dt.datetime(2021, 10, 3) and a["long"] == Decimal(5)
    assert a["flags"] == [True, False] and a["days"] == [dt.datetime(2021, 10, 3)] and a["unicode"] == "😀"
    assert b["greeting"] == "multi\nline\tcell" and b["json"] == '{"a":2.5}' and b["flags"] == []
    assert b["date"] == dt.datetime(2021, 10, 4, 1, 2, 3) and b["long"] == Decimal("6.5")
    assert all(v is None for k, v in c.items() if k != "sys_key")


def test_tsv_round_trip(spark, tmp_path):
    cells, key = T.read_tsv(spark, _file(tmp_path, SMALL), multi_line=True)
    table = RecordTable("t", T.load_tsv(cells, key), key)
    out = str(tmp_path / "out")
    write_tsv(table, out)
    back, back_key = T.read_tsv(spark, out, multi_line=True)
    assert back_key == key and back.columns == ["sys_key", *sorted(c for c in cells.columns if c != key)]
    again = RecordTable("t", T.load_tsv(back, key, T.infer_tsv(cells, key)), key)
    assert collect(tsv_cells(again)) == collect(tsv_cells(table))


@pytest.mark.parametrize(
    "text,key",
    [("", None), ("a\tb\n", None), ("a\t \n1\t2\n", None), ("a\ta\n1\t2\n", None), ("a\tb\n1\t2\n", "c")],
)
def test_bad_headers(spark, tmp_path, text, key):
    with pytest.raises(InvalidTsv):
        T.read_tsv(spark, _file(tmp_path, text), key)


@pytest.mark.parametrize("rows", ["x\t1\nx\t2\n", "x\t1\n\t2\n", "x\t1\n  \t2\n"])
def test_bad_keys(spark, tmp_path, rows):
    cells, key = T.read_tsv(spark, _file(tmp_path, "id\tv\n" + rows))
    with pytest.raises(InvalidTsv):
        T.load_tsv(cells, key)


def test_header_names_need_no_care(spark, tmp_path):
    cells, key = T.read_tsv(spark, _file(tmp_path, "id\tA\ta\tdot.ted\n1\tx\ty\tz\n"), "a")
    assert key == "a" and collect(T.load_tsv(cells, key)) == [("y", Decimal(1), "x", "z")]


def test_operations(spark, tmp_path):
    ops = [
        {"operation": "upsert", "record": {"id": "1", "type": "t", "attributes": {"n": 1, "s": "12", "l": [1, 2.5], "j": {"b": 1, "a": 2}}}},
        {"operation": "upsert", "record": {"id": "2", "type": "t", "attributes": {"n": None, "s": "2020-01-01"}}},
        {"operation": "delete", "record": {"id": "1", "type": "t"}},
    ]
    path = _file(tmp_path, json.dumps(ops), "ops.json")
    read = O.read_operations(spark, path, multi_line=True)
    names = O.attribute_names(read)
    assert names == ["j", "l", "n", "s"]
    kinds = {r["attribute"]: A(r["attribute_type"]) for r in O.infer_operations(read, names).collect()}
    assert kinds == {"j": A.JSON, "l": A.ARRAY_OF_NUMBER, "n": A.NUMBER, "s": A.STRING}
    assert {r["attribute"]: A(r["attribute_type"]) for r in O.infer_operations(read).collect()} == kinds
    feed = O.typed_feed(read, kinds).orderBy("seq").collect()
    assert [(r["operation"], r["record_id"], r["n"], r["s"], r["l"], r["j"]) for r in feed] == [
        ("upsert", "1", 1, "12", [1, Decimal("2.5")], '{"a":2,"b":1}'), ("upsert", "2", None, "2020-01-01", None, None),
        ("delete", "1", None, None, None, None),
    ]
    assert [sorted(r["given"] or []) for r in feed] == [["j", "l", "n", "s"], ["n", "s"], []]


NESTED = [
    {"id": "f1", "name": "file", "object": {"label": "x", "size": 1.5, "parts": [{"element": 1}, {"element": 2}], "sid": "123e4567-e89b-12d3-a456-426614174000", "consent": ["NRES"]},
     "relations": [{"dst_id": "d1", "dst_name": "donor"}, {"dst_id": "d2", "dst_name": "donor"}, {"dst_id": "s1", "dst_name": "study"}]},
    {"id": "f2", "name": "file", "object": {"label": "y", "size": 2.5, "parts": [], "sid": "nope", "consent": []}, "relations": []},
    {"id": "d1", "name": "donor", "object": {"label": "z", "size": None, "parts": None, "sid": None, "consent": ["NRES", "GRU"]},
     "relations": [{"dst_id": "s1", "dst_name": "study"}]},
]


def test_nested(spark, tmp_path):
    path = _file(tmp_path, "\n".join(map(json.dumps, NESTED)), "rows.json")
    rows = N.read_nested(spark, path, "json")
    base = N.base_records(rows, "file")
    assert collect(base.select("id", "label", "size", "parts")) == [("f1", "x", 1.5, [1, 2]), ("f2", "y", 2.5, [])]
    related = N.relation_records(rows, "file", ["donor", "study"])
    assert collect(related) == [("f1", "d2", "s1")]
    assert RecordTable("file", related, "id").relations == {"donor": "donor", "study": "study"}
    assert collect(N.snapshot_ids(rows, "sid")) == [("123e4567-e89b-12d3-a456-426614174000",)]
    assert collect(N.consent_gate(rows, "file", "consent")) == [(1, True)]
    assert collect(N.consent_gate(rows, "donor", "consent")) == [(1, False)]
    assert collect(N.consent_gate(rows, "none", "consent")) == [(0, False)]


def test_values(spark):
    df = spark.sql(
        """SELECT cast(0.1 as float) f, cast('NaN' as double) nan, named_struct('b', 1, 'a', 'x') s, map('k', 1) m,
           X'00FF7F' bytes, array(named_struct('tags_tuple', 'p')) tags, array(named_struct('a', 1, 'b', 2)) two,
           cast(1.50 as decimal(5,2)) d, timestamp'2020-01-01 00:00:00' ts, array(cast('NaN' as double), 1D) nans"""
    )
    row = N.convert_columns(df).first()
    assert row["f"] == 0.1 and row["nan"] is None and row["s"] == '{"b":1,"a":"x"}' and row["m"] == '{"k":1}'
    assert row["bytes"] == "[0, -1, 127]" and row["tags"] == ["p"] and row["two"] == ['{"a":1,"b":2}']
    assert row["d"] == Decimal("1.50") and row["ts"] == dt.datetime(2020, 1, 1) and row["nans"] == [None, 1.0]
    times = spark.range(1).select(
        N.time_value(F.lit(3723000000)).alias("a"), N.time_value(F.lit(3723500000)).alias("b"), N.time_value(F.lit(3723000001)).alias("c"),
        N.date_value(F.lit(18262)).alias("d"), N.date_time_value(F.lit(1577836800000001)).alias("e"), N.byte_list(F.unhex(F.lit(""))).alias("z"),
    ).first()
    assert tuple(times) == ("01:02:03", "01:02:03.500", "01:02:03.000001", dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 1), "[]")


def _manifest(tmp_path, spark, files=("sample", "person")):
    spark.sql("SELECT 1 AS sample_id, 'p1' AS person, array('p1','p2') AS people, 9 AS row").write.parquet(str(tmp_path / "sample"))
    spark.sql("SELECT 'p1' AS person_id, cast(1.5 as float) AS score").write.parquet(str(tmp_path / "person"))

    def table(name, *keys):
        return {"name": name, "primaryKey": list(keys), "columns": [{"name": "c", "datatype": "string", "array_of": False}]}

    def relation(source, target, column):
        return {"name": source, "from": {"table": "sample", "column": source}, "to": {"table": target, "column": column}}

    model = {
        "extra": 1,
        "snapshot": {
            "id": "snap", "tables": [table("sample", "sample_id"), table("person", "person_id"), table("pair", "a", "b"), {"name": "bare", "primaryKey": None}],
            "relationships": [relation("person", "person", "person_id"), relation("people", "person", "person_id"),
                              relation("row", "pair", "a"), relation("row", "bare", MANIFEST_DEFAULT_KEY)],
        },
        "format": {"parquet": {"location": {"tables": [{"name": n, "paths": [str(tmp_path / n)]} for n in files]}}},
    }
    return _file(tmp_path, json.dumps(model), "manifest.json")


def test_manifest(spark, tmp_path):
    path = _manifest(tmp_path, spark)
    manifest = M.read_manifest(spark, path)
    assert collect(M.manifest_keys(manifest).select("table", "primary_key")) == [
        ("bare", MANIFEST_DEFAULT_KEY), ("pair", MANIFEST_DEFAULT_KEY), ("person", "person_id"), ("sample", "sample_id")
    ]
    assert collect(M.manifest_relations(manifest).select("from_column", "to_table")) == [("people", "person"), ("person", "person"), ("row", "bare")]
    tables = M.load_manifest(spark, path)
    sample = tables["sample"]
    assert sample.primary_key == "sample_id" and sample.df.first()["sample_id"] == "1"
    assert sample.relations == {"person": "person", "people": "person", "row": "bare"}
    assert tables["person"].df.first()["score"] == 1.5
    from recordloom.operators.traverse import follow

    assert collect(follow(tables, "sample", ["people"]).select("sys_root", "person_id")) == [("1", "p1")]


def test_manifest_with_undeclared_files(spark, tmp_path):
    path = _manifest(tmp_path, spark, ("sample", "stranger"))
    with pytest.raises(MissingObject):
        M.load_manifest(spark, path)


def test_relation_uris(spark):
    df = spark.sql("SELECT 1 AS a, array(1, 2) AS b")
    got = N.relation_uris(df, {"a": "t", "b": "t"})
    assert tuple(got.first()) == (f"{RELATION_SCHEME}/t/1", [f"{RELATION_SCHEME}/t/1", f"{RELATION_SCHEME}/t/2"])


@pytest.mark.parametrize(
    ("second", "message"),
    [("id\ty\tx\n2\t3\t4\n", "header"), ("id\tx\ty\n2\t3\t4\t5\n", "more cells"), (b"id\tx\ty\n2\t\xff\t4\n", "UTF-8")],
)
def test_tsv_faults_are_errors(spark, tmp_path, second, message):
    """Columns in another order, a surplus cell, bytes that are no UTF-8: each in the second of two files."""
    (tmp_path / "a.tsv").write_text("id\tx\ty\n1\t1\t2\n")
    (tmp_path / "b.tsv").write_bytes(second if isinstance(second, bytes) else second.encode())
    with pytest.raises(Exception, match=message):
        T.read_tsv(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])[0].collect()


def test_tsv_rows_with_fewer_cells_end_in_nulls(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tx\ty\n1\t"a\tb"\n2\tc\td\n')
    cells, _ = T.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert collect(cells) == [("1", "a\tb", None), ("2", "c", "d")]


def test_operations_of_several_files_keep_their_order(spark, tmp_path):
    """The later file is the larger one, which Spark reads first."""
    def line(x):
        return json.dumps({"operation": "upsert", "record": {"id": "1", "type": "t", "attributes": {"x": x}}}) + "\n"

    (tmp_path / "part-0").write_text(line(-1))
    (tmp_path / "part-1").write_text("".join(line(i) for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = O.read_operations(spark, str(tmp_path)).selectExpr("seq", "variant_get(attributes['x'], '$', 'int') AS x").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["x"] for r in sorted(rows, key=lambda r: r["seq"])] == list(range(-1, 3000))
    assert len({r["seq"] for r in rows}) == 3001


def test_types_follow_files_by_name_not_by_size(spark, tmp_path):
    days = "".join(f"{i}\t2020-01-{i:02}\t2020-01-{i:02}T01:02:03\n" for i in range(1, 3))
    times = "".join(f"{i}\t2020-01-02T01:02:03\t2020-01-02\n" for i in range(10, 3000))
    (tmp_path / "a.tsv").write_text("id\tday\tat\n" + days)
    (tmp_path / "b.tsv").write_text("id\tday\tat\n" + times)
    cells, key = T.read_tsv(spark, [str(tmp_path / "b.tsv"), str(tmp_path / "a.tsv")])
    assert T.infer_tsv(cells, key) == {"day": A.DATE_TIME, "at": A.STRING}
    assert dict(T.load_tsv(cells.filter("id != '1'"), key).dtypes)["day"] == "timestamp_ntz"
    # of cells that were shuffled the order of arrival is all there is
    assert set(T.infer_tsv(cells.repartition(3), key)) == {"day", "at"}


def test_a_nested_file_becomes_related_tables(spark, tmp_path):
    from recordloom.operators.traverse import follow

    rows = [
        {"id": "1", "name": "sample", "object": {"n": 1.5, "who": "x"}, "relations": [{"dst_id": "a", "dst_name": "donor"}, {"dst_id": "b", "dst_name": "donor"}]},
        {"id": "a", "name": "donor", "object": {"who": "ann", "donor": "self"}, "relations": []},
        {"id": "2", "name": "sample", "object": {"n": None}, "relations": None},
        {"id": "b", "name": "donor", "object": {"who": "bob"}, "relations": [{"dst_id": "a", "dst_name": "donor"}]},
        {"id": "9", "name": "007", "object": {}, "relations": []},
    ]
    (tmp_path / "rows.json").write_text("\n".join(json.dumps(r) for r in rows))
    tables, counts = N.load_nested(N.read_nested(spark, str(tmp_path), "json"))
    assert counts == {"sample": 2, "donor": 2, "007": 1}
    assert tables["sample"].attributes == ["id", "donor", "n", "who"] and tables["007"].attributes == ["id"]
    assert tables["donor"].relations == {"donor": "donor"}
    assert collect(tables["sample"].df.select("id", "n", "donor")) == [("1", 1.5, "b"), ("2", None, None)]
    assert collect(follow(tables, "sample", ["donor", "donor"]).select("sys_root", "who")) == [("1", "ann")]
    (tmp_path / "odd.json").write_text('{"id": "3", "object": {"n": 2}}')
    with pytest.raises(InvalidName):
        N.load_nested(N.read_nested(spark, str(tmp_path), "json"))


def test_places_leave_rows_in_their_tasks(spark, tmp_path):
    """One file's rows never meet in one task to learn its rank: the table of files goes to them, however large they look."""
    path = str(tmp_path / "numbers")
    spark.range(0, 1000, 1, 4).selectExpr("cast(id as string) AS id").write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = with_place(spark.read.parquet(path), "place")
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert [r["id"] for r in placed.orderBy("place").collect()] == [str(n) for n in range(1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
