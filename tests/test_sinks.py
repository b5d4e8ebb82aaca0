"""Versioned tables, exports, schema changes and streams."""

import json

import pytest
from pyspark.sql import functions as F

from recordloom.errors import Conflict, InvalidName, InvalidRelation, MissingObject
from recordloom.functions.infer import tsv_type
from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable, tag
from recordloom.operators import evolve as E
from recordloom.operators import jobs as J
from recordloom.sinks import export as X
from recordloom.sinks.table import read_table, upsert_table, versions, write_version
from recordloom.sources.tsv import typed_cell
from recordloom.streaming.ingest import start_upserts
from recordloom.streaming.status import start_status_fold
from tests.conftest import collect


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = tag(spark.range(100).selectExpr("cast(id as string) id", "id % 7 as r"), "id", relations={"r": "x"})
    assert read_table(spark, path, "t") is None
    assert write_version(df, path, "id") == 0 and write_version(df.limit(5), path, "id") == 1
    assert versions(spark, path) == [0, 1]
    newest, first = read_table(spark, path, "t"), read_table(spark, path, "t", 0)
    assert newest.df.count() == 5 and first.df.count() == 100
    assert newest.primary_key == "id" and newest.relations == {"r": "x"}
    (tmp_path / "t" / "version=9").mkdir()
    assert versions(spark, path) == [0, 1]


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = tag(spark.range(200).selectExpr("cast(id as string) id", "id as n"), "id")
    write_version(df, path, "id", buckets=8)
    change = spark.createDataFrame([("7", 70, "new")], "id string, n long, note string")
    table = upsert_table(spark, path, "t", "id", change)
    assert len([p for p in (tmp_path / "t" / "upsert=1").iterdir() if p.is_dir()]) == 1
    assert table.df.count() == 200 and table.df.filter("note is null").count() == 199
    assert tuple(table.df.filter("id = '7'").first()) == ("7", 70, "new")
    # a change of type rewrites all of it
    text = tag(spark.createDataFrame([("8", "x")], "id string, n string"), "id")
    table = upsert_table(spark, path, "t", "id", text)
    assert (tmp_path / "t" / "version=2").exists() and table.types["n"] is A.STRING
    assert table.df.filter("id = '7'").first()["n"] == "70" and table.df.count() == 200
    assert read_table(spark, path, "t", 0).df.filter("id = '7'").first()["n"] == 7
    assert versions(spark, path) == [0, 1, 2]


def test_lost_version_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    write_version(tag(spark.createDataFrame([("1", 1)], "id string, n int"), "id"), path, "id")
    change = spark.createDataFrame([("1", 2)], "id string, n int")
    upsert_table(spark, path, "t", "id", change, version=5)
    (tmp_path / "t" / "upsert=5" / "_SUCCESS").unlink()
    assert read_table(spark, path, "t").df.first()["n"] == 1
    assert upsert_table(spark, path, "t", "id", change, version=5).df.first()["n"] == 2


def test_a_taken_version_is_an_error(spark, tmp_path, monkeypatch):
    """Two writers that saw the same versions: the second one fails and changes nothing."""
    from recordloom.sinks import table as sink

    path = str(tmp_path / "t")
    rows = lambda n: tag(spark.createDataFrame([("1", n)], "id string, n int"), "id")
    assert write_version(rows(1), path, "id") == 0
    monkeypatch.setattr(sink, "next_version", lambda spark, path: 1)
    write_version(rows(2), path, "id")
    with pytest.raises(Exception, match="already exists"):
        write_version(rows(3), path, "id")
    assert read_table(spark, path, "t").df.first()["n"] == 2


def _fake(spark):
    df = spark.sql("SELECT 'r1' AS id, 'hi \"x\"' AS name, 2.50D AS num, array('a', 'b') AS arr, cast(null as string) AS gone, 'p9' AS rel, array('p1') AS rels, cast(array() as array<string>) AS none, '{\"k\":[1]}' AS j")
    return RecordTable("thing", tag(df, "id", {"j": A.JSON}, {"rel": "person", "rels": "person", "none": "person"}), "id")


def test_entity_operations(spark, tmp_path):
    path = str(tmp_path / "ops")
    X.write_entity_operations(_fake(spark), path, "pfb")
    entity = json.loads(spark.read.text(path).first()[0])
    assert (entity["name"], entity["entityType"]) == ("r1", "thing")
    ref = lambda i: {"entityType": "person", "entityName": i}
    assert entity["operations"] == [
        {"op": "RemoveAttribute", "attributeName": "pfb:arr"}, {"op": "CreateAttributeValueList", "attributeName": "pfb:arr"},
        {"op": "AddListMember", "attributeListName": "pfb:arr", "newMember": "a"},
        {"op": "AddListMember", "attributeListName": "pfb:arr", "newMember": "b"},
        {"op": "AddUpdateAttribute", "attributeName": "pfb:j", "addUpdateAttribute": {"k": [1]}},
        {"op": "AddUpdateAttribute", "attributeName": "pfb:thing_name", "addUpdateAttribute": 'hi "x"'},
        {"op": "RemoveAttribute", "attributeName": "pfb:none"}, {"op": "CreateAttributeValueList", "attributeName": "pfb:none"},
        {"op": "AddUpdateAttribute", "attributeName": "pfb:num", "addUpdateAttribute": 2.5},
        {"op": "AddUpdateAttribute", "attributeName": "pfb:rel", "addUpdateAttribute": ref("p9")},
        {"op": "RemoveAttribute", "attributeName": "pfb:rels"},
        {"op": "CreateAttributeEntityReferenceList", "attributeListName": "pfb:rels"},
        {"op": "AddListMember", "attributeListName": "pfb:rels", "newMember": ref("p1")},
    ]


@pytest.mark.parametrize(
    "name,kind,prefix,want",
    [("name", "t", "pfb", "pfb:t_name"), ("x", "t", "pfb", "pfb:x"), ("a:x", "t", "pfb", "a:x"), ("name", "t", "tdr", "tdr:name"),
     ("entityType", "t", "tdr", "tdr:entityType"), ("t_id", "t", "tdr", "tdr:t_id"), ("x", "t", "tdr", "x"), ("name", "t", None, "name")],
)
def test_export_names(name, kind, prefix, want):
    assert X.export_name(name, kind, prefix) == want


def test_schema_changes(spark):
    table = E.create_type(spark, "t", {"a": A.NUMBER, "b": A.NULL, "r": A.RELATION}, "id", {"r": "x"})
    assert table.types == {"id": A.STRING, "a": A.NUMBER, "b": A.STRING, "r": A.RELATION} and table.relations == {"r": "x"}
    assert E.evolve(table, {"a": A.NULL, "c": A.ARRAY_OF_DATE}).types["c"] is A.ARRAY_OF_DATE
    assert E.evolve(table, {"a": A.BOOLEAN}).types["a"] is A.STRING
    with pytest.raises(InvalidRelation):
        E.evolve(table, {"r": A.STRING})
    with pytest.raises(InvalidName):
        E.add_columns(table, {"sys_x": A.STRING})
    with pytest.raises(InvalidName):
        E.rename_attribute(table, "a", "x;y")
    for bad in (lambda: E.rename_attribute(table, "id", "k"), lambda: E.rename_attribute(table, "a", "b"), lambda: E.drop_attribute(table, "id")):
        with pytest.raises(Conflict):
            bad()
    with pytest.raises(MissingObject):
        E.drop_attribute(table, "zz")
    other = E.create_type(spark, "x", {"v": A.STRING}, "id")
    with pytest.raises(Conflict):
        E.drop_type(Collection.of(table, other), "x")
    assert E.drop_type(Collection.of(table, other), "t").record_types() == ["x"]


def test_widening_keeps_values(spark):
    df = spark.sql("SELECT '1' id, 1.50BD n, true b, array(1.5D, null) ns, array(date'2020-01-02') ds")
    table = RecordTable("t", df, "id")
    wide = E.evolve(table, {"n": A.STRING, "b": A.NUMBER, "ns": A.ARRAY_OF_STRING, "ds": A.ARRAY_OF_DATE_TIME}).df.first()
    assert (wide["n"], wide["b"], wide["ns"], str(wide["ds"][0])) == ("1.5", "true", ["1.5", None], "2020-01-02 00:00:00")
    mixed = E.evolve(table, {"ns": A.STRING}).df.first()
    assert mixed["ns"] == "[1.5,null]"


def _drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_of_batches_evolves_and_upserts(spark, tmp_path):
    """Three runs of one stream: types widen, columns appear, values overwrite."""
    source, path, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    schema = "id string, seq long, a string, b string"

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        start_upserts(stream, path, "t", "id", "seq", tsv_type, typed_cell, state).awaitTermination()

    _drop(source, "1.json", [{"id": "1", "seq": 1, "a": "5"}, {"id": "1", "seq": 2, "a": "6"}, {"id": "2", "seq": 3, "a": "7"}])
    run()
    table = read_table(spark, path, "t")
    assert table.types == {"id": A.STRING, "a": A.NUMBER, "b": A.STRING}
    _drop(source, "2.json", [{"id": "2", "seq": 4, "a": "x", "b": "[1]"}])
    run()
    run()
    table = read_table(spark, path, "t")
    assert collect(table.df.select("id", "a", "b")) == [("1", "6", None), ("2", "x", "[1]")]
    assert table.types["a"] is A.STRING


def test_status_stream(spark, tmp_path):
    source = tmp_path / "in"
    seen = {}

    def sink(rows, batch_id):
        seen.update({r["job_id"]: r["status"] for r in rows.collect()})

    def run():
        stream = spark.readStream.schema("job_id string, seq long, status string").json(str(source))
        start_status_fold(stream, str(tmp_path / "state"), sink).awaitTermination()

    _drop(source, "1.json", [{"job_id": "a", "seq": 1, "status": "RUNNING"}, {"job_id": "b", "seq": 2, "status": "ERROR"}])
    run()
    assert seen == {"a": "RUNNING", "b": "ERROR"}
    _drop(source, "2.json", [{"job_id": "a", "seq": 3, "status": "SUCCEEDED"}, {"job_id": "b", "seq": 4, "status": "SUCCEEDED"}])
    run()
    assert seen == {"a": "SUCCEEDED", "b": "ERROR"}


def test_status_rules(spark):
    updates = spark.createDataFrame(
        [("a", 1, "RUNNING"), ("a", 2, "UNKNOWN"), ("a", 3, "SUCCEEDED"), ("a", 4, "SUCCEEDED"), ("a", 5, "ERROR"), ("b", 1, "RUNNING")],
        "job_id string, seq long, status string",
    )
    assert collect(J.classify_updates(updates)) == [("a", 1, 2, 2), ("b", 0, 1, 0)]
    bad = spark.createDataFrame([("Strange",)], "s string").select(J.job_status(F.col("s")))
    with pytest.raises(Exception, match="unknown status"):
        bad.collect()


def test_import_rules(spark):
    requests = spark.createDataFrame(
        [("NESTED", "https://ok.org/a"), ("NESTED", "drs://d.org/x"), ("MANIFEST", "drs://d.org/x"), ("NESTED", "https://no.org/a"),
         ("NESTED", "https://secret.org/data/1"), ("OPERATIONS", "gs://bucket/a.json"), ("NESTED", "relative/path"), ("NESTED", "https://notok.org/a")],
        "import_type string, url string",
    )
    source = J.ImportSource((r"^https://secret\.org/data/",), private_workspace=True, groups=("g1",))
    rows = J.check_imports(requests, {"https": [r"ok\.org"], "drs": [r"d\.org"], "gs": ["bucket"]}, [source]).collect()
    assert [r["allowed"] for r in rows] == [True, True, False, False, True, True, False, False]
    assert rows[4]["private_workspace"] and rows[4]["required_groups"] == ["g1"] and not rows[0]["private_workspace"]
    assert rows[2]["problem"] == "scheme not allowed: drs" and rows[6]["problem"] == "not an absolute URL"


def test_catalog(spark):
    from recordloom.operators import catalog as C

    def rows(*values):
        return spark.createDataFrame(list(values), "id string, workspace_id string, name string, description string")

    catalog = rows(("c1", "w1", "one", "d"), ("c2", "w2", "one", "d"))
    filled = C.ensure_defaults(catalog, spark.createDataFrame([("w1",), ("w3",), ("w3",)], "workspace_id string"))
    assert collect(filled.select("id", "name")) == [("c1", "one"), ("c2", "one"), ("w1", "default"), ("w3", "default")]
    assert C.ensure_defaults(filled, filled).count() == 5
    assert C.add_collections(catalog, rows(("c3", "w1", "two", ""))).count() == 3
    changed = C.update_collections(catalog, rows(("c1", "w1", "uno", "x")))
    assert collect(changed) == [("c1", "w1", "uno", "x"), ("c2", "w2", "one", "d")]
    assert collect(C.drop_collections(catalog, rows(("c1", "w1", "", "")))) == [("c2", "w2", "one", "d")]
    assert C.find_collections(catalog, rows(("c1", "w2", "", ""))).count() == 0
    for bad in (
        lambda: C.add_collections(catalog, rows(("c1", "w9", "two", ""))), lambda: C.add_collections(catalog, rows(("c3", "w1", "one", ""))),
        lambda: C.drop_collections(catalog, rows(("c1", "w2", "", ""))),
    ):
        with pytest.raises(Conflict):
            bad()
    with pytest.raises(MissingObject):
        C.update_collections(catalog, rows(("c1", "w2", "x", "")))
