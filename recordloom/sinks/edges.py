"""Stored edges in two orders: by the record they lead from and by the one they lead to.

Both copies are versioned Parquet in hash buckets, as records are. A delta rewrites the buckets that its ids fall into,
which are different ones in the two copies. References to a record are read from the copy by ``to_id`` alone: the buckets
of the ids asked for, and in them the row groups whose statistics admit them. Edges that a delta takes away stay in the
buckets it writes, as not live, until these are written again: so a bucket that has lost all its edges is written too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.edges import apply_delta
from recordloom.sinks.table import DEFAULT_BUCKETS, bucket, bucket_folders, next_version, write_folder

#: The columns that copies are dealt by.
FROM, TO = "from_id", "to_id"
_FULL, _DELTA = "version=", "upsert="
SCHEMA = "from_id string, to_id string, live boolean"


def write_edges(edges: DataFrame, path: str, version: int | None = None, buckets: int = DEFAULT_BUCKETS) -> int:
    """Write all edges in both orders as the next version, or the one named; the second copy is made from the first."""
    path = path.rstrip("/")
    number = next_version(edges.sparkSession, f"{path}/{FROM}") if version is None else version
    for side in (FROM, TO):
        write_folder(edges.select(FROM, TO, F.lit(True).alias("live")), f"{path}/{side}/{_FULL}{number}", side, buckets, version is not None)
        edges = edges.sparkSession.read.schema(SCHEMA).parquet(f"{path}/{side}/{_FULL}{number}")
    return number


def _copy(spark: SparkSession, path: str, side: str, version: int | None, only: set[int] | None = None) -> DataFrame:
    folders, _ = bucket_folders(spark, f"{path.rstrip('/')}/{side}", version)
    wanted = [f for b, f in sorted(folders.items()) if only is None or b in only]
    rows = spark.read.schema(SCHEMA).parquet(*wanted) if wanted else spark.createDataFrame([], SCHEMA)
    return rows.where("live").select(FROM, TO)


def read_edges(spark: SparkSession, path: str, side: str = FROM, version: int | None = None) -> DataFrame:
    """All edges, from the copy dealt by ``side``."""
    return _copy(spark, path, side, version)


def _touched(ids: DataFrame, side: str, count: int) -> set[int]:
    return {r[0] for r in ids.select(bucket(F.col(side), count)).distinct().collect()}


def apply_stored_delta(spark: SparkSession, path: str, delta: DataFrame, version: int | None = None) -> int:
    """Change both copies by a delta ``(from_id, to_id, added)``, as the next version or the one named.

    ``delta`` should be a stored table, as both copies read it. A version that was cut short is written again by name.
    """
    path = path.rstrip("/")
    number = next_version(spark, f"{path}/{FROM}") if version is None else version
    for side in (FROM, TO):
        _, count = bucket_folders(spark, f"{path}/{side}", number - 1)
        part = _copy(spark, path, side, number - 1, _touched(delta, side, count))
        live = apply_delta(part, delta).withColumn("live", F.lit(True))
        gone = delta.where("not added").select(FROM, TO, F.lit(False).alias("live"))
        write_folder(live.unionByName(gone), f"{path}/{side}/{_DELTA}{number}", side, count, version is not None)
    return number


def inbound(spark: SparkSession, path: str, ids: DataFrame, version: int | None = None) -> DataFrame:
    """Edges that lead to ``ids.record_id``; only the buckets of these ids are read."""
    asked = ids.select(F.col("record_id").alias(TO)).distinct()
    _, count = bucket_folders(spark, f"{path.rstrip('/')}/{TO}", version)
    return _copy(spark, path, TO, version, _touched(asked, TO, count) if count else None).join(asked, TO, "left_semi")
