"""Record tables as versioned Parquet folders.

A write makes a new version next to the old ones and is seen only once it is
whole, so readers never meet half a batch and a failed job changes nothing.

Records are spread over hash buckets of their key, each a folder of files sorted by
key: a lookup by id reads the files whose statistics admit it. A *full* version
(``version=N``) has all buckets, an *upsert* (``upsert=N``) only those it changed;
a reader takes each bucket from the newest version that has it. Small change sets
thus rewrite the buckets they touch, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.model import RecordTable, quoted
from recordloom.operators.ingest import merge_records

_FULL, _UPSERT, _BUCKET = "version=", "upsert=", "bucket_of_"
_DONE = "_SUCCESS"
DEFAULT_BUCKETS = 16


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, on whatever file system it lives; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def finished(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><number>`` below ``path`` that are whole."""
    names = [n for n in _children(spark, path) if n.startswith(prefix)]
    return sorted(int(n.removeprefix(prefix)) for n in names if _DONE in _children(spark, f"{path}/{n}"))


def _history(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Finished versions, oldest first, with their folders."""
    return sorted((n, f"{prefix}{n}") for prefix in (_FULL, _UPSERT) for n in finished(spark, path, prefix))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions below ``path``, oldest first."""
    return [v for v, _ in _history(spark, path.rstrip("/"))]


def bucket_folders(spark: SparkSession, path: str, version: int | None) -> tuple[dict[int, str], int]:
    """Folder of each bucket as of a version, and the number of buckets."""
    folders: dict[int, str] = {}
    count = 0
    for number, name in _history(spark, path):
        if version is not None and number > version:
            break
        if name.startswith(_FULL):
            folders = {}
        for bucket in _children(spark, f"{path}/{name}"):
            if bucket.startswith(_BUCKET):
                of, which = bucket.removeprefix(_BUCKET).split("=")
                folders[int(which)] = f"{path}/{name}/{bucket}"
                count = int(of)
    return folders, count


def bucket(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def next_version(spark: SparkSession, path: str) -> int:
    """A number above those of all versions, finished or not."""
    names = _children(spark, path)
    return max((int(n.removeprefix(p)) for n in names for p in (_FULL, _UPSERT) if n.startswith(p)), default=-1) + 1


def write_folder(df: DataFrame, folder: str, key: str, buckets: int, replace: bool) -> None:
    """Write a version's folder. Unless the caller named the version, to write it again after a loss, the folder must
    not be there: that someone else has taken the number meanwhile is an error."""
    column = f"{_BUCKET}{buckets}"
    placed = df.withColumn(column, bucket(quoted(key), buckets))
    # ranges of (bucket, key) are even however many records a bucket has
    ranged = placed.repartitionByRange(column, quoted(key)).sortWithinPartitions(column, quoted(key))
    ranged.write.mode("overwrite" if replace else "error").partitionBy(column).parquet(folder)


def write_version(
    df: DataFrame, path: str, primary_key: str, version: int | None = None, buckets: int = DEFAULT_BUCKETS
) -> int:
    """Write ``df`` as a full version: the next one, or the one named."""
    path = path.rstrip("/")
    number = next_version(df.sparkSession, path) if version is None else version
    write_folder(df, f"{path}/{_FULL}{number}", primary_key, buckets, version is not None)
    return number


def read_table(spark: SparkSession, path: str, name: str, version: int | None = None) -> RecordTable | None:
    """The newest version (or the named one); None where there is none yet."""
    folders, _ = bucket_folders(spark, path.rstrip("/"), version)
    return read_buckets(spark, folders, name) if folders else None


def read_buckets(spark: SparkSession, folders: dict[int, str], name: str, only=None) -> RecordTable:
    # attributes are only ever added between full versions, so the newest folder
    # has the schema of all
    newest = max(folders.values(), key=lambda f: int(f.rsplit("/", 2)[1].split("=")[1]))
    schema = spark.read.parquet(newest).schema
    wanted = [f for b, f in sorted(folders.items()) if only is None or b in only]
    if not wanted:
        return RecordTable.of(name, spark.createDataFrame([], schema))
    return RecordTable.of(name, spark.read.schema(schema).parquet(*wanted))


def touched_buckets(keys: DataFrame, key: str, count: int) -> set[int]:
    """The buckets that the keys fall into; one number per bucket reaches the driver."""
    return {r["b"] for r in keys.select(bucket(quoted(key), count).alias("b")).distinct().collect()}


def read_touched(spark: SparkSession, path: str, name: str, keys: DataFrame, key: str, version: int | None = None) -> RecordTable | None:
    """The buckets of a stored table that the keys fall into; None where there is no table yet."""
    folders, count = bucket_folders(spark, path.rstrip("/"), version)
    return read_buckets(spark, folders, name, touched_buckets(keys, key, count)) if folders else None


def upsert_table(
    spark: SparkSession,
    path: str,
    name: str,
    key: str,
    records: DataFrame,
    version: int | None = None,
    buckets: int = DEFAULT_BUCKETS,
) -> RecordTable:
    """Evolve and upsert typed records into the stored table, as a new version.

    The version builds on the newest one before it. Only the buckets of the given
    keys are read and written, unless an attribute changes its type.
    """
    path = path.rstrip("/")
    number = next_version(spark, path) if version is None else version
    named = version is not None
    folders, count = bucket_folders(spark, path, number - 1)
    if not folders:
        merged = merge_records(None, name, key, records)
        write_folder(merged.df, f"{path}/{_FULL}{number}", key, buckets, named)
        return read_table(spark, path, name, number)
    only = touched_buckets(records, key, count)
    part = read_buckets(spark, folders, name, only)
    merged = merge_records(part, name, key, records)
    if all(merged.types[c] is t for c, t in part.types.items()):
        write_folder(merged.df, f"{path}/{_UPSERT}{number}", key, count, named)
    else:
        whole = merge_records(read_buckets(spark, folders, name), name, key, records)
        write_folder(whole.df, f"{path}/{_FULL}{number}", key, count, named)
    return read_table(spark, path, name, number)
