"""Guards of writes, and edges that follow them."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME
from recordloom.errors import Conflict, InvalidRelation
from recordloom.model import AttributeType as A
from recordloom.model import Collection, RecordTable, tag
from recordloom.operators import edges as E
from recordloom.operators import integrity as I
from recordloom.operators import write as W
from recordloom.operators.ingest import merge_records
from recordloom.operators.traverse import edges, follow
from recordloom.sinks.edges import apply_stored_delta, inbound, read_edges, write_edges
from tests.conftest import collect

URI = f"{RELATION_SCHEME}/%s/%s"


@pytest.fixture(scope="module")
def tables(spark):
    nation = RecordTable("nation", tag(spark.createDataFrame([("n1", "x"), ("n2", "y"), ("n3", "z")], "id string, name string"), "id"), "id")
    rows = [("p1", "n1", None), ("p2", "n1", "p1"), ("p3", "n2", "p2"), ("p4", None, None)]
    person = tag(spark.createDataFrame(rows, "id string, nation string, boss string"), "id", relations={"nation": "nation", "boss": "person"})
    visited = spark.createDataFrame([("p1", "n1"), ("p1", "n2"), ("p2", "n2")], "from_id string, to_id string")
    return Collection.of(nation, RecordTable("person", person, "id", {"visited": ("nation", visited)}))


def persons(spark, rows):
    full = [(i, n and URI % ("nation", n), b and URI % ("person", b)) for i, n, b in rows]
    return tag(spark.createDataFrame(full, "id string, nation string, boss string"), "id", {"nation": A.RELATION, "boss": A.RELATION})


def merge(tables, records, **kw):
    return merge_records(tables["person"], "person", "id", records, collection=tables, **kw)


def test_dangling_relations_are_refused(spark, tables):
    with pytest.raises(InvalidRelation, match="p9 nation NOPE"):
        merge(tables, persons(spark, [("p9", "NOPE", None), ("p1", "n3", None)]), guard="refuse")
    got = merge(tables, persons(spark, [("p9", "n3", "p8"), ("p8", "n1", "p1")]), guard="refuse")
    assert collect(got.df.where("id in ('p8', 'p9')").select("id", "nation", "boss")) == [("p8", "n1", "p1"), ("p9", "n3", "p8")]
    with pytest.raises(Conflict):
        merge(tables, persons(spark, []), guard="maybe")
    with pytest.raises(Conflict):
        merge_records(tables["person"], "person", "id", persons(spark, []), guard="refuse")


def test_records_that_rely_on_bad_ones_are_set_aside_too(spark, tables):
    rows = [("q1", "NOPE", None), ("q2", None, "q1"), ("q3", None, "q2"), ("q4", "n1", "q5"), ("q5", "n1", "q4"), ("p1", "n3", "gone")]
    table, problems = merge(tables, persons(spark, rows), guard="report")
    assert collect(problems.select("record_id", "attribute", "target")) == [
        ("p1", "boss", "gone"), ("q1", "nation", "NOPE"), ("q2", "boss", "q1"), ("q3", "boss", "q2")
    ]
    left = {r["id"]: r["nation"] for r in table.df.collect()}
    assert left == {"p1": "n1", "p2": "n1", "p3": "n2", "p4": None, "q4": "n1", "q5": "n1"}


def test_a_new_table_is_guarded_as_well(spark, tables):
    rows = tag(spark.createDataFrame([("1", URI % ("nation", "n1")), ("2", URI % ("nation", "n7"))], "id string, at string"), "id", {"at": A.RELATION})
    table, problems = merge_records(None, "trip", "id", rows, guard="report", collection=tables)
    assert collect(table.df) == [("1", "n1")] and [r["record_id"] for r in problems.collect()] == ["2"]


def ids(spark, *wanted):
    return spark.createDataFrame([(i,) for i in wanted], "record_id string")


def test_deletes_that_would_leave_references_are_refused(spark, tables):
    with pytest.raises(Conflict, match="n1 is referred to"):
        W.delete_request(tables["nation"], ids=ids(spark, "n1", "n3"), guard="refuse", collection=tables)
    with pytest.raises(Conflict, match="n9 does not exist"):
        W.delete_request(tables["nation"], ids=ids(spark, "n9", "n3"), guard="refuse", collection=tables)
    assert collect(W.delete_request(tables["nation"], ids=ids(spark, "n3"), guard="refuse", collection=tables).select("id")) == [("n1",), ("n2",)]
    left, problems = W.delete_request(tables["nation"], ids=ids(spark, "n1", "n2", "n3", "n9"), guard="report", collection=tables)
    assert collect(left.select("id")) == [("n1",), ("n2",)]
    assert collect(problems.select("record_id", "problem", "references")) == [
        ("n1", "is referred to", 3), ("n2", "is referred to", 3), ("n9", "does not exist", None)
    ]


def test_references_within_a_delete_go_with_it(spark, tables):
    left = W.delete_request(tables["person"], ids=ids(spark, "p1", "p2", "p3"), guard="refuse", collection=tables)
    assert collect(left.select("id")) == [("p4",)]
    # p3 stays outside, so p2 is needed, and then p1 is
    left, problems = W.delete_request(tables["person"], ids=ids(spark, "p1", "p2", "p4"), guard="report", collection=tables)
    assert collect(left.select("id")) == [("p1",), ("p2",), ("p3",)]
    assert collect(problems.select("record_id")) == [("p1",), ("p2",)]
    left, _ = W.delete_request(tables["person"], delete_all=True, excluded=ids(spark, "p2"), guard="report", collection=tables)
    assert collect(left.select("id")) == [("p1",), ("p2",)]


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_references_are_cut_down_before_they_are_shuffled(spark, sf, tmp_path):
    from recordloom.plans.star import star

    tables = star(spark, sf)
    few = spark.sql("SELECT * FROM VALUES ('1'), ('2') AS asked(record_id)")
    found = I.blocked_deletes(tables, "customer", few)
    tree = plan(found).split("\n\n")[0]
    # few ids are sent to the references, which meet them before anything is exchanged to be counted
    assert tree.index(" Exchange (") < tree.index("BroadcastHashJoin LeftSemi")
    assert tree.count(" Exchange (") == 1
    known = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    size = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    try:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, "-1")
        spark.conf.set(size, "0")
        asked = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING' and c_acctbal < 100").select(F.col("c_custkey").cast("string").alias("record_id"))
        assert "might_contain" in plan(I.blocked_deletes(tables, "customer", asked))
    finally:
        spark.conf.unset(size)
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, known[k]) if k in known else spark.conf.unset(k)


def test_repeated_keys_fail_the_plan(spark):
    table = RecordTable("t", tag(spark.createDataFrame([("1", 1)], "id string, n int"), "id"), "id")
    twice = spark.createDataFrame([("1", 2), ("1", 3), ("2", 4)], "id string, n int")
    with pytest.raises(Exception, match="more than once: 1"):
        W.upsert(table, twice).collect()
    assert collect(W.upsert(table, W.latest(twice, "id", "n"), unique=True)) == [("1", 3), ("2", 4)]
    with pytest.raises(Exception, match="more than once"):
        merge_records(table, "t", "id", tag(twice, "id")).df.collect()


def test_edges_follow_an_upsert(spark, tables):
    rows = [("p1", [URI % ("nation", "n3"), URI % ("nation", "n3")]), ("p2", None), ("p9", [URI % ("nation", "n1")])]
    records = tag(spark.createDataFrame(rows, "id string, visited array<string>"), "id", {"visited": A.ARRAY_OF_RELATION})
    after = merge(tables, records)
    assert "visited" not in after.df.columns
    assert collect(edges(after, "visited")) == [("p1", "n3"), ("p9", "n1")]
    reached = follow(tables.replace(after), "person", ["visited"])
    assert collect(reached.select("sys_root", "name")) == [("p1", "z"), ("p9", "x")]
    with pytest.raises(InvalidRelation):
        merge(tables, tag(spark.createDataFrame([("p1", [URI % ("person", "p2")])], "id string, visited array<string>"), "id", {"visited": A.ARRAY_OF_RELATION}))
    bad = tag(spark.createDataFrame([("p3", [URI % ("nation", "n8")])], "id string, visited array<string>"), "id", {"visited": A.ARRAY_OF_RELATION})
    kept, problems = merge(tables, bad, guard="report")
    assert collect(problems.select("record_id", "target")) == [("p3", "n8")] and edges(kept, "visited").count() == 3


@pytest.mark.parametrize("seed", [1, 2, 1_000_000])
def test_deltas_equal_a_rebuild(spark, tmp_path_factory, seed):
    """Stored in both orders, edges after several deltas are those of the last array that each record was given."""
    rng = random.Random(seed)
    path = str(tmp_path_factory.mktemp("edges"))
    state = {str(r): {str(rng.randint(0, 9)) for _ in range(rng.randint(0, 5))} for r in range(12)}
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "from_id string, to_id string")
    write_edges(frame({(r, t) for r, ts in state.items() for t in ts}), path, buckets=4)
    for i in range(2):
        given_now = {str(rng.randint(0, 14)): {str(rng.randint(0, 9)) for _ in range(rng.randint(0, 5))} for _ in range(4)}
        touched = spark.createDataFrame([(r,) for r in given_now], "record_id string")
        delta = E.edge_delta(read_edges(spark, path), touched, frame({(r, t) for r, ts in given_now.items() for t in ts}))
        delta.write.parquet(f"{path}/delta-{i}")
        apply_stored_delta(spark, path, spark.read.parquet(f"{path}/delta-{i}"))
        state |= given_now
    want = sorted((r, t) for r, ts in state.items() for t in ts)
    for side in ("from_id", "to_id"):
        assert collect(read_edges(spark, path, side).select("from_id", "to_id")) == want
    asked = spark.createDataFrame([("3",), ("4",)], "record_id string")
    assert collect(inbound(spark, path, asked).select("from_id", "to_id")) == [p for p in want if p[1] in "34"]


def test_change_batches_are_guarded(spark, tables, tmp_path):
    import json

    from recordloom.operators.ingest import apply_operations
    from recordloom.sources.operations import read_operations

    def batch(name, *ops):
        rows = [{"operation": kind, "record": {"id": rid, "type": "person", "attributes": given}} for kind, rid, given in ops]
        (tmp_path / name).write_text(json.dumps(rows))
        return read_operations(spark, str(tmp_path / name), multi_line=True)

    plain = RecordTable("person", tables["person"].df, "id")
    related = tables.replace(plain)
    fine = batch("fine.json", ("delete", "p3", {}), ("upsert", "p4", {"nation": URI % ("nation", "n3")}), ("delete", "p2", {}))
    got = apply_operations(plain, "person", fine, "id", guard="refuse", collection=related)
    assert collect(got.df.select("id", "nation")) == [("p1", "n1"), ("p4", "n3")]
    # p1 is still the boss of p2, q2 names q1, whose nation does not exist; p3 goes and comes back
    bad = batch(
        "bad.json", ("delete", "p1", {}), ("upsert", "q1", {"nation": URI % ("nation", "no")}),
        ("upsert", "q2", {"boss": URI % ("person", "q1")}), ("delete", "p3", {}), ("upsert", "p3", {"nation": URI % ("nation", "n3")}),
    )
    with pytest.raises(InvalidRelation):
        apply_operations(plain, "person", bad, "id", guard="refuse", collection=related)
    got, problems = apply_operations(plain, "person", bad, "id", guard="report", collection=related)
    assert collect(got.df.select("id", "nation", "boss")) == [("p1", "n1", None), ("p2", "n1", "p1"), ("p3", "n3", None), ("p4", None, None)]
    assert sorted(r["record_id"] for r in problems.collect()) == ["p1", "q1", "q2"]


def test_a_bucket_that_loses_all_its_edges(spark, tmp_path):
    path = str(tmp_path / "edges")
    write_edges(spark.createDataFrame([("1", "a"), ("2", "b")], "from_id string, to_id string"), path, buckets=64)
    gone = spark.createDataFrame([("1", "a", False)], "from_id string, to_id string, added boolean")
    apply_stored_delta(spark, path, gone)
    for side in ("from_id", "to_id"):
        assert collect(read_edges(spark, path, side)) == [("2", "b")]
    assert inbound(spark, path, ids(spark, "a")).count() == 0
