"""Feeds in any order and any number of pieces."""

import random

import pytest

from recordloom.functions.infer import tsv_type
from recordloom.model import RecordTable, tag
from recordloom.operators import registers as R
from recordloom.operators import write as W
from recordloom.sinks.table import read_table
from recordloom.sources.tsv import typed_cell
from recordloom.streaming.changes import merge_piece, read_records, start_changes, start_table
from recordloom.streaming.ingest import start_upserts
from tests.conftest import collect

FIELDS = "seq long, operation string, record_id string, s string, n int, given array<string>"


def _table(spark):
    rows = [("1", "a", 1), ("2", "b", 2), ("3", "c", 3)]
    return RecordTable("t", tag(spark.createDataFrame(rows, "id string, s string, n int"), "id"), "id")


def operations(seed, n=80):
    """Half of them about one id; some upserts set nothing."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        rid = "1" if rng.random() < 0.5 else str(rng.randint(1, 8))
        if rng.random() < 0.3:
            rows.append((seq, "delete", rid, None, None, []))
        else:
            given = [c for c in ("s", "n") if rng.random() < 0.5]
            rows.append((seq, "upsert", rid, f"s{seq}" if "s" in given and rng.random() < 0.9 else None, seq if "n" in given else None, given))
    return rng, rows


@pytest.mark.parametrize("seed", range(4))
def test_pieces_commute(spark, seed):
    rng, rows = operations(seed)
    want = collect(W.apply_changes(_table(spark), spark.createDataFrame(rows, FIELDS), ["s", "n"], given="given"))
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(len(rows)), 2))
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    table = _table(spark)
    for piece in [*pieces, pieces[0]]:
        table = R.apply_piece(table, spark.createDataFrame(piece, FIELDS), ["s", "n"], given="given")
        table = table.with_df(spark.createDataFrame(table.df.collect(), table.df.schema))
    assert collect(R.visible(table).df) == want
    assert R.visible(table).df.schema["id"].metadata == {"primary_key": True}


def test_a_late_upsert_does_not_bring_a_record_back(spark):
    frame = lambda *ops: spark.createDataFrame([(q, o, "9", s, None, ["s"]) for q, o, s in ops], FIELDS)
    table = R.apply_piece(_table(spark), frame((5, "delete", None)), ["s", "n"], given="given")
    table = R.apply_piece(table, frame((3, "upsert", "late")), ["s", "n"], given="given")
    assert collect(R.visible(table).df.select("id")) == [("1",), ("2",), ("3",)]
    table = R.apply_piece(table, frame((6, "upsert", "back")), ["s", "n"], given="given")
    assert collect(R.visible(table).df.where("id = '9'")) == [("9", "back", None)]


def test_stored_pieces_and_new_attributes(spark, tmp_path):
    path = str(tmp_path / "t")
    start_table(_table(spark), path, buckets=4)
    one = spark.createDataFrame([(1, "upsert", "2", "x")], "seq long, operation string, record_id string, s string")
    merge_piece(path, "t", "id", one, ["s"], 1)
    merge_piece(path, "t", "id", one, ["s"], 1)
    more = spark.createDataFrame([(0, "upsert", "2", "old", True), (2, "delete", "3", None, None)], "seq long, operation string, record_id string, s string, extra boolean")
    merge_piece(path, "t", "id", more, ["s", "extra"], 2)
    assert collect(read_records(spark, path, "t").df) == [("1", "a", 1, None), ("2", "x", 2, True)]
    assert collect(read_records(spark, path, "t", 0).df) == [("1", "a", 1), ("2", "b", 2), ("3", "c", 3)]


def test_a_stream_of_changes_is_taken_up_again(spark, tmp_path):
    _, rows = operations(11, 60)
    want = collect(W.apply_changes(_table(spark), spark.createDataFrame(rows, FIELDS), ["s", "n"], given="given"))
    random.Random(1).shuffle(rows)
    path, source, state = (str(tmp_path / n) for n in ("t", "in", "state"))
    start_table(_table(spark), path, buckets=4)
    for i in range(3):
        spark.createDataFrame(rows[i::3], FIELDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FIELDS).parquet(source)
        start_changes(stream, path, "t", "id", ["s", "n"], state, given="given").awaitTermination()
    assert collect(read_records(spark, path, "t").df) == want


def test_late_rows_do_not_overwrite(spark, tmp_path):
    path, source, state = (str(tmp_path / n) for n in ("t", "in", "state"))
    schema = "id string, seq long, v string"
    for batch in ([("1", 10, "new"), ("2", 1, "a")], [("1", 5, "old"), ("2", 3, "c"), ("3", 2, "x")], [("2", 2, "b")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        start_upserts(stream, path, "t", "id", "seq", tsv_type, typed_cell, state).awaitTermination()
    assert collect(read_table(spark, path, "t").df.select("id", "v")) == [("1", "new"), ("2", "c"), ("3", "x")]
