"""Decisions on status updates, update by update and after a restart."""

from datetime import datetime, timedelta

from recordloom.operators.jobs import classify_updates, fold_statuses
from recordloom.streaming.decisions import decide, start_decisions
from tests.conftest import collect

SCHEMA = "job_id string, seq long, status string, updated timestamp"


def at(hour):
    return datetime(2024, 1, 1) + timedelta(hours=hour)


def test_decisions_go_on_after_a_restart(spark, tmp_path):
    batches = [
        [("a", 1, "RUNNING", at(0)), ("b", 2, "ERROR", at(0)), ("c", 3, "RUNNING", at(0)), ("a", 4, "WAITING", at(1))],
        [("a", 5, "SUCCEEDED", at(2)), ("b", 6, "ERROR", at(2)), ("b", 7, "SUCCEEDED", at(2))],
        [("a", 9, "ERROR", at(20)), ("a", 8, "SUCCEEDED", at(20)), ("d", 10, "RUNNING", at(20))],
    ]
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        start_decisions(spark.readStream.schema(SCHEMA).parquet(source), path, state).awaitTermination()
    got = collect(spark.read.parquet(path).select("job_id", "seq", "status", "decision"))
    assert got == [
        ("a", 1, "RUNNING", "ignored"), ("a", 4, "WAITING", "rejected"), ("a", 5, "SUCCEEDED", "accepted"),
        ("a", 8, "SUCCEEDED", "ignored"), ("a", 9, "ERROR", "rejected"), ("b", 2, "ERROR", "accepted"),
        ("b", 6, "ERROR", "ignored"), ("b", 7, "SUCCEEDED", "rejected"), ("c", 3, "RUNNING", "ignored"),
        ("c", None, "ERROR", "stalled"), ("d", 10, "RUNNING", "ignored"),
    ]


def test_an_update_moves_the_timer_and_a_stalled_job_stays_so(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([("a", 1, "RUNNING", at(0)), ("x", 2, "ERROR", at(5))], [("a", 3, "RUNNING", at(5.5)), ("x", 4, "ERROR", at(10))],
                 [("x", 5, "ERROR", at(12))], [("a", 6, "SUCCEEDED", at(13))]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        start_decisions(spark.readStream.schema(SCHEMA).parquet(source), path, state).awaitTermination()
    mine = collect(spark.read.parquet(path).where("job_id = 'a'").select("seq", "decision"))
    # not stalled at 6 because of the update half an hour before; stalled at half past 11, seen when the time had come to 12
    assert mine == [(1, "ignored"), (3, "ignored"), (6, "rejected"), (None, "stalled")]


def test_counts_are_those_of_the_whole(spark, tmp_path):
    rows = [(f"j{i % 7}", i, ("RUNNING", "RUNNING", "SUCCEEDED", "ERROR")[i * i % 11 % 4], at(0)) for i in range(60)]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    updates = spark.createDataFrame(rows, SCHEMA)
    updates.coalesce(1).write.parquet(source)
    start_decisions(spark.readStream.schema(SCHEMA).parquet(source), path, str(tmp_path / "state"), None).awaitTermination()
    got = spark.read.parquet(path).groupBy("job_id").pivot("decision", ["accepted", "ignored", "rejected"]).count().fillna(0)
    assert collect(got) == collect(classify_updates(updates).select("job_id", "accepted", "ignored", "rejected"))


def test_jobs_are_folded_by_hash(spark):
    rows = [("a", 3, "ERROR"), ("a", 2, "SUCCEEDED"), ("b", 1, "RUNNING"), ("c", 5, "SUCCEEDED"), ("c", 4, "ERROR"), ("d", 1, "ERROR")]
    folded = fold_statuses(spark.createDataFrame(rows, "job_id string, seq long, status string"))
    assert collect(folded) == [("a", "SUCCEEDED", 2), ("b", "RUNNING", None), ("c", "ERROR", 4), ("d", "ERROR", 1)]
    assert "SortAggregate" not in folded._sc._jvm.PythonSQLUtils.explainString(folded._jdf.queryExecution(), "formatted")


def test_states_go_to_python_in_batches(spark, tmp_path):
    """A job costs no call to the state store of its own; nulls and large numbers come through."""
    rows = [("a", 2**60 + 1, "RUNNING", at(0)), ("b", None, "ERROR", at(1)), (None, 2**60 + 3, None, at(2))]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    assert "TransformWithState" not in decide(stream, timedelta(hours=6))._jdf.queryExecution().logical().toString()
    start_decisions(stream, path, str(tmp_path / "state")).awaitTermination()
    got = collect(spark.read.parquet(path).select("job_id", "seq", "status", "decision"))
    assert got == [(None, 2**60 + 3, None, "rejected"), ("a", 2**60 + 1, "RUNNING", "ignored"), ("b", None, "ERROR", "accepted")]
