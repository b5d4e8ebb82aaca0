"""Traversal and expressions over a hand-made graph, with a hot record."""

import json

import pytest

from recordloom.errors import InvalidRelation
from recordloom.model import Collection, RecordTable, tag
from recordloom.operators.expressions import evaluate, evaluate_members, this
from recordloom.operators.traverse import follow, follow_members, member_page
from recordloom.constants import RELATION_SCHEME
from tests.conftest import collect


@pytest.fixture(scope="module")
def graph(spark):
    study = spark.createDataFrame([("s1", 'The "one"', 1.5), ("s2", "two", None)], "study_id string, title string, cost double")
    donor = spark.createDataFrame(
        [("d1", "s1", "ann", "d2"), ("d2", "s2", "bob", None), ("d3", None, "cy", "gone")],
        "donor_id string, study string, name string, parent string",
    )
    uris = lambda *ids: [f"{RELATION_SCHEME}/donor/{i}" for i in ids]
    group = spark.createDataFrame(
        [("g1", uris("d1", "d2", "d3")), ("g2", uris("d2", "d2")), ("g3", []), ("g4", None)], "group_id string, donors array<string>"
    )
    return Collection.of(
        RecordTable("study", tag(study, "study_id"), "study_id"),
        RecordTable("donor", tag(donor, "donor_id", relations={"study": "study", "parent": "donor"}), "donor_id"),
        RecordTable("group", tag(group, "group_id", relations={"donors": "donor"}), "group_id"),
    )


def test_hops(graph):
    assert collect(follow(graph, "donor", ["study"]).select("sys_root", "title")) == [("d1", 'The "one"'), ("d2", "two")]
    assert collect(follow(graph, "group", ["donors"]).select("sys_root", "name")) == [
        ("g1", "ann"), ("g1", "bob"), ("g1", "cy"), ("g2", "bob"), ("g2", "bob")
    ]
    assert collect(follow(graph, "group", ["donors", "parent", "study"]).select("sys_root", "study_id")) == [("g1", "s2")]
    assert collect(follow(graph, "donor", ["parent"], roots=["d1"]).select("sys_root", "donor_id")) == [("d1", "d2")]
    with pytest.raises(InvalidRelation):
        follow(graph, "donor", ["name"])


def test_member_pages(graph):
    page, _ = member_page(graph, "group", ["donors"], page_size=2)
    assert collect(page.select("sys_array_root", "sys_root")) == [("g1", "d1"), ("g1", "d2"), ("g2", "d2")]
    second = follow_members(graph, "group", ["donors"], ["study"], page_size=2, offset=1)
    assert collect(second.select("sys_array_root", "sys_root", "study_id")) == [("g1", "d2", "s2")]


def test_expressions(graph):
    rows = evaluate(
        graph, "donor",
        {
            "t": {"n": this("name"), "s": [this("study", "title"), this("study", "cost"), 1, "x"], "id": this("DONOR_ID")},
            "parent": this("parent", "name"), "rel": this("study"), "none": this("nothing"),
        },
    ).collect()
    got = {r["record_id"]: (json.loads(r["t"]), r["parent"], r["rel"], r["none"]) for r in rows}
    assert got == {
        "d1": ({"n": "ann", "s": ['The "one"', 1.5, 1, "x"], "id": "d1"}, '"bob"', f'"{RELATION_SCHEME}/study/s1"', "null"),
        "d2": ({"n": "bob", "s": ["two", None, 1, "x"], "id": "d2"}, "null", f'"{RELATION_SCHEME}/study/s2"', "null"),
        "d3": ({"n": "cy", "s": [None, None, 1, "x"], "id": "d3"}, "null", "null", "null"),
    }


def test_array_expressions(graph):
    wanted = {"names": this("donors", "name"), "titles": this("donors", "study", "title"), "costs": this("donors", "study", "cost")}
    rows = {r["record_id"]: tuple(r)[1:] for r in evaluate(graph, "group", wanted).collect()}
    assert rows == {
        "g1": ('["ann","bob","cy"]', '["The \\"one\\"","two"]', "[1.5]"),
        "g2": ('["bob","bob"]', '["two","two"]', "[]"), "g3": ("[]", "[]", "[]"), "g4": ("[]", "[]", "[]"),
    }
    with pytest.raises(InvalidRelation):
        evaluate(graph, "group", {"x": this("donors", "nope", "name")})


def test_member_expressions(graph):
    rows = evaluate_members(graph, "group", ["donors"], {"n": this("name"), "t": this("study", "title")}, page_size=2)
    assert collect(rows.select("sys_array_root", "record_id", "has_next", "n", "t")) == [
        ("g1", "d1", True, '"ann"', '"The \\"one\\""'), ("g1", "d2", True, '"bob"', '"two"'), ("g2", "d2", False, '"bob"', '"two"')
    ]
    only = evaluate_members(graph, "group", ["donors"], {"t": this("study", "title")}, page_size=5)
    assert [r[1] for r in collect(only.select("sys_array_root", "record_id"))] == ["d1", "d2", "d2"]


def test_same_path_is_followed_once(graph, capsys):
    wanted = {"a": this("study", "title"), "b": this("study", "cost"), "c": [this("study", "study_id")]}
    evaluate(graph, "donor", wanted).explain()
    plan = capsys.readouterr().out
    assert plan.count("Join") == 1


def test_hot_member_is_cut_before_the_shuffle(spark, capsys):
    """One group holds most members; the plan ranks per task before it exchanges."""
    edges = spark.range(20_000).selectExpr("'g1' as from_id", "cast(id as string) as to_id")
    donors = spark.range(20_000).selectExpr("cast(id as string) as donor_id", "id as n")
    groups = spark.createDataFrame([("g1",), ("g2",)], "group_id string")
    c = Collection.of(
        RecordTable("group", groups, "group_id", {"donors": ("donor", edges)}), RecordTable("donor", donors, "donor_id")
    )
    page, _ = member_page(c, "group", ["donors"], page_size=3, offset=2)
    page.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    want = sorted(str(i) for i in range(20_000))[2:5]
    assert [r["sys_root"] for r in page.orderBy("sys_root").collect()] == want


def test_large_arrays_are_set_apart_whole(spark, graph):
    from recordloom.operators.expressions import evaluate_bounded

    wanted = {"n": this("donors", "name"), "id": this("group_id")}
    shaped, long = evaluate_bounded(graph, "group", wanted, max_values=2)
    assert collect(shaped) == [("g2", '["bob","bob"]', '"g2"'), ("g3", "[]", '"g3"'), ("g4", "[]", '"g4"')]
    assert collect(long.select("record_id", "path", "target_id", "value")) == [
        ("g1", "", "g1", '"g1"'), ("g1", "donors", "d1", '"ann"'), ("g1", "donors", "d2", '"bob"'), ("g1", "donors", "d3", '"cy"')
    ]


def test_member_page_is_ranked_once(spark, sf):
    """The executed plan reuses the ranked exchange for every place that needs the page."""
    from recordloom.plans import registry

    df = registry.load()[0]["expr_eval_array"](spark, sf)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_target_is_split(spark):
    """A customer with most of the orders: the join's big partition is split, the rows stay whole."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        orders = spark.range(0, 200_000, 1, 16).selectExpr(
            "cast(id as string) order_id", "case when id % 3 = 0 then 'hot' else cast(id % 1000 as string) end as buyer"
        )
        buyers = spark.range(1000).selectExpr("cast(id as string) buyer_id").union(spark.sql("select 'hot'"))
        c = Collection.of(
            RecordTable("orders", tag(orders, "order_id", relations={"buyer": "buyer"}), "order_id"),
            RecordTable("buyer", buyers, "buyer_id"),
        )
        reached = follow(c, "orders", ["buyer"])
        assert len(reached.collect()) == 200_000
        assert "skew=true" in reached._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
