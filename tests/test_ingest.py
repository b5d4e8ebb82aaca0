"""Uploads end to end: TSV and JSON batches merged into tables."""

import json
from decimal import Decimal

import pytest

from recordloom.constants import RELATION_SCHEME
from recordloom.errors import Conflict, InvalidRelation
from recordloom.model import AttributeType as A
from recordloom.operators.ingest import apply_operations, merge_records
from recordloom.sources.operations import read_operations
from recordloom.sources.tsv import load_tsv, read_tsv
from tests.conftest import collect

URI = f"{RELATION_SCHEME}/test/"


def _tsv(spark, tmp_path, name, text, key=None):
    (tmp_path / name).write_text(text)
    cells, key = read_tsv(spark, str(tmp_path / name), key, multi_line=True)
    return load_tsv(cells, key), key


def test_uploads_merge(spark, tmp_path):
    first, key = _tsv(spark, tmp_path, "a.tsv", "id\tn\tempty\tlist\n1\t5\t\t[]\n2\t6\t\t\n")
    table = merge_records(None, "t", key, first)
    assert table.types == {"id": A.STRING, "n": A.NUMBER, "empty": A.STRING, "list": A.ARRAY_OF_STRING}
    second, _ = _tsv(spark, tmp_path, "b.tsv", "id\tn\tempty\tlist\textra\n2\tx\t7\t[1]\ttrue\n3\t\t\t[]\t\n")
    table = merge_records(table, "t", key, second)
    assert table.types == {"id": A.STRING, "n": A.STRING, "empty": A.STRING, "list": A.ARRAY_OF_STRING, "extra": A.BOOLEAN}
    assert collect(table.df.select("id", "n", "empty", "list", "extra")) == [
        ("1", "5", None, [], None), ("2", "x", "7", ["1"], True), ("3", None, None, [], None)
    ]
    third, _ = _tsv(spark, tmp_path, "c.tsv", "id\tn\textra\n1\t\t\n")
    kept = merge_records(table, "t", key, third)
    assert kept.types["extra"] is A.BOOLEAN and kept.types["n"] is A.STRING
    with pytest.raises(Conflict):
        merge_records(table, "t", "n", second.withColumnRenamed("n", "k").withColumnRenamed("id", "n"))


def test_upload_of_relations(spark, tmp_path):
    text = f'rel_id\trel\tarr\nA\t"{URI}1"\t["{URI}1", "{URI}2"]\nB\t{URI}2\t["{URI}2"]\nC\t\t\n'
    records, key = _tsv(spark, tmp_path, "r.tsv", text)
    table = merge_records(None, "r", key, records)
    assert table.relations == {"rel": "test", "arr": "test"}
    assert [r[0] for r in collect(table.df.filter("rel = '2'").select("rel_id"))] == ["B"]
    other, _ = _tsv(spark, tmp_path, "s.tsv", f"rel_id\trel\nA\t{RELATION_SCHEME}/else/1\n")
    with pytest.raises(InvalidRelation):
        merge_records(table, "r", key, other)
    plain, _ = _tsv(spark, tmp_path, "p.tsv", "rel_id\trel\nA\thello\n")
    with pytest.raises(InvalidRelation):
        merge_records(table, "r", key, plain)


def test_json_batch(spark, tmp_path):
    def op(kind, rid, **attributes):
        return {"operation": kind, "record": {"id": rid, "type": "t", "attributes": attributes}}

    ops = [
        op("upsert", "1", n=1, day="2020-01-01", rel=f"{URI}9"), op("upsert", "2", n=2, tags=["a", "b"]),
        op("delete", "1"), op("upsert", "3", day="2020-01-01T10:00:00"), op("upsert", "1", n=10),
    ]
    (tmp_path / "ops.json").write_text(json.dumps(ops))
    table = apply_operations(None, "t", read_operations(spark, str(tmp_path / "ops.json"), multi_line=True), "id")
    assert table.types == {
        "id": A.STRING, "n": A.NUMBER, "day": A.DATE_TIME, "rel": A.RELATION, "tags": A.ARRAY_OF_STRING
    }
    assert table.relations == {"rel": "test"}
    rows = {r["id"]: (r["n"], str(r["day"]), r["rel"], r["tags"]) for r in table.df.collect()}
    # an upsert sets what it names and nothing else
    assert rows == {
        "1": (Decimal(10), "None", None, None), "2": (Decimal(2), "None", None, ["a", "b"]),
        "3": (None, "2020-01-01 10:00:00", None, None),
    }
    more = [op("upsert", "2", n="many"), op("delete", "3")]
    (tmp_path / "more.json").write_text(json.dumps(more))
    table = apply_operations(table, "t", read_operations(spark, str(tmp_path / "more.json"), multi_line=True), "id")
    rows = {r["id"]: (r["n"], r["tags"]) for r in table.df.collect()}
    assert rows == {"1": ("10", None), "2": ("many", ["a", "b"])}
