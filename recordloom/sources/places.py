"""Where rows stand in the files they are read from."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file's bytes, and so the places in it, are told by so many bits.
FILE_BITS = 42
#: Of local files, listings and rows write the same address with other slashes.
_LOCAL = "^file:/+"


def with_place(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place as a number called ``name``: files by name, and rows by where they stand in them.

    Of formats that number rows, that number counts. Otherwise a row's number within its task, which is less than the
    bytes before it, is added to where its part of the file begins: this rises along the file, in whatever order parts
    are dealt to tasks. Spark reads larger files first, so numbers in the order of tasks would not do. Rows that don't
    come straight from files are an AnalysisException.
    """
    files = sorted(re.sub(_LOCAL, "file:/", f) for f in rows.inputFiles())
    ranks = rows.sparkSession.createDataFrame(list(enumerate(files)), "sys_file_rank long, sys_file string")
    file = F.regexp_replace("_metadata.file_path", _LOCAL, "file:/").alias("sys_file")
    try:
        placed = rows.select("*", file, F.col("_metadata.row_index").alias("sys_place"))
    except AnalysisException:
        # the lower bits count the rows of a task
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        placed = rows.select("*", file, (F.col("_metadata.file_block_start") + within).alias("sys_place"))
    number = F.shiftleft("sys_file_rank", FILE_BITS) + F.col("sys_place")
    # Spark doesn't know that this table is small: it would send the rows to it, or sort all rows of a file in one task
    return placed.join(F.broadcast(ranks), "sys_file").withColumn(name, number).drop("sys_file", "sys_file_rank", "sys_place")


def in_place(rows: DataFrame, name: str) -> DataFrame:
    """``with_place``, or the order in which rows come to tasks where they don't come straight from files."""
    try:
        return with_place(rows, name)
    except AnalysisException:
        return rows.withColumn(name, F.monotonically_increasing_id())
