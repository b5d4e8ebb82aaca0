"""Upserts, deletes and change feeds against row-by-row application."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.errors import Conflict, InvalidRelation, MissingObject
from recordloom.model import Collection, RecordTable, tag
from recordloom.operators import integrity as I
from recordloom.operators import write as W
from recordloom.operators.inference import relation_targets
from recordloom.constants import RELATION_SCHEME
from recordloom.model import AttributeType as A
from tests.conftest import collect


def _table(spark, rows=(("1", "a", 1), ("2", "b", 2), ("3", "c", 3))):
    return RecordTable("t", tag(spark.createDataFrame(list(rows), "id string, s string, n int"), "id"), "id")


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "record_id string")


def test_upsert_touches_given_columns_only(spark):
    changes = spark.createDataFrame([("2", None, "x"), ("9", 90, "y")], "id string, n int, extra string")
    got = W.upsert(_table(spark), changes)
    assert collect(got.select("id", "s", "n", "extra")) == [
        ("1", "a", 1, None), ("2", "b", None, "x"), ("3", "c", 3, None), ("9", None, 90, "y")
    ]
    assert got.schema["id"].metadata == {"primary_key": True}


def test_insert_missing_replace_patch(spark):
    table = _table(spark)
    assert collect(W.insert_missing(table, _ids(spark, "3", "4", "4"))) == [
        ("1", "a", 1), ("2", "b", 2), ("3", "c", 3), ("4", None, None)
    ]
    new = spark.createDataFrame([("1", 10)], "id string, n int")
    assert collect(W.replace_records(table, new).select("id", "s", "n"))[0] == ("1", None, 10)
    assert collect(W.patch_records(table, new).select("id", "s", "n"))[0] == ("1", "a", 10)
    given = spark.createDataFrame([("1", None, 5, ["s"]), ("2", "z", 6, ["n"])], "id string, s string, n int, g array<string>")
    assert collect(W.patch_records(table, given, "g"))[:2] == [("1", None, 1), ("2", "b", 6)]
    with pytest.raises(MissingObject):
        W.patch_records(table, spark.createDataFrame([("7", 1)], "id string, n int"))


def test_deletes(spark):
    table = _table(spark)
    assert [r[0] for r in collect(W.delete_request(table, ids=_ids(spark, "2", "8")))] == ["1", "3"]
    assert [r[0] for r in collect(W.delete_request(table, delete_all=True, excluded=_ids(spark, "2")))] == ["2"]
    assert W.delete_request(table, delete_all=True).count() == 0
    assert collect(W.missing_ids(table, _ids(spark, "2", "8"))) == [("8",)]
    for bad in ({}, {"ids": _ids(spark, "1"), "delete_all": True}, {"excluded": _ids(spark, "1")}):
        with pytest.raises(Conflict):
            W.delete_request(table, **bad)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_feed_equals_replay(spark, seed):
    """Half of the feed is about one id."""
    rng = random.Random(seed)
    state = {"1": ("a", 1), "2": ("b", 2), "3": ("c", 3)}
    rows = []
    for seq in range(200):
        rid = "1" if rng.random() < 0.5 else str(rng.randint(1, 12))
        if rng.random() < 0.25:
            rows.append((seq, "delete", rid, None, None, []))
        else:
            given = [c for c in ("s", "n") if rng.random() < 0.4]
            rows.append((seq, "upsert", rid, f"s{seq}" if "s" in given else None, seq if "n" in given else None, given))
    for seq, op, rid, s, n, flags in rows:
        if op == "delete":
            state.pop(rid, None)
        else:
            old = state.get(rid, (None, None))
            state[rid] = (s if "s" in flags else old[0], n if "n" in flags else old[1])
    rng.shuffle(rows)
    feed = spark.createDataFrame(rows, "seq long, operation string, record_id string, s string, n int, given array<string>")
    got = W.apply_changes(_table(spark), feed, ["s", "n"], given="given")
    assert {r["id"]: (r["s"], r["n"]) for r in got.collect()} == state


def test_integrity(spark):
    a = RecordTable("a", tag(spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "id string, r string"), "id", relations={"r": "b"}), "id")
    edges = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "q")], "from_id string, to_id string")
    a = RecordTable("a", a.df, "id", {"many": ("b", edges)})
    b = RecordTable("b", spark.createDataFrame([("x",), ("z",)], "id string"), "id")
    c = Collection.of(a, b)
    assert collect(I.dangling_relations(c, "a", "r")) == [("2", "y")]
    assert collect(I.dangling_relations(c, "a", "many")) == [("2", "q")]
    assert collect(I.blocked_deletes(c, "b", _ids(spark, "x", "z"))) == [("x", 3)]
    new = spark.createDataFrame([("2", "z")], "from_id string, to_id string")
    assert collect(I.replace_edges(edges, _ids(spark, "2"), new)) == [("1", "x"), ("2", "z")]


def test_relation_rules(spark):
    table = RecordTable("a", tag(spark.createDataFrame([("1", "x", "t")], "id string, r string, s string"), "id", relations={"r": "b"}), "id")

    def targets(column, *uris):
        df = spark.createDataFrame([(u,) for u in uris], f"{column} string")
        return relation_targets(df, {column: A.RELATION})

    u = f"{RELATION_SCHEME}/%s/1"
    I.validate_relations(table, targets("r", u % "b", u % "b"))
    I.validate_relations(table, targets("fresh", u % "c"))
    for column, uris in (("r", [u % "c"]), ("s", [u % "b"]), ("fresh", [u % "b", u % "c"])):
        with pytest.raises(InvalidRelation):
            I.validate_relations(table, targets(column, *uris))
    mixed = spark.createDataFrame([([u % "b", u % "c"],)], "m array<string>")
    with pytest.raises(InvalidRelation):
        I.validate_relations(table, relation_targets(mixed, {"m": A.ARRAY_OF_RELATION}))
