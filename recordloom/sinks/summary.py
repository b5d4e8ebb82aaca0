"""What inference knows of a stored table's columns, kept beside its versions.

A table that has been inferred once needs not be read again when more cells arrive: their summary is merged with the one
kept before, and the types are those of all cells ever uploaded, in the order of uploads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.model import AttributeType as A
from recordloom.operators.inference import column_types, merge_summaries
from recordloom.sinks.table import finished

_SUMMARY = "summary="


def kept_summary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest summary, of ``version`` or before; None where there is none."""
    path = path.rstrip("/")
    numbers = [n for n in finished(spark, path, _SUMMARY) if version is None or n <= version]
    return spark.read.parquet(f"{path}/{_SUMMARY}{max(numbers)}") if numbers else None


def keep_summary(summary: DataFrame, path: str, version: int) -> dict[str, A]:
    """Merge a summary with the one kept before ``version``, keep it as that version's, and return the columns' types.

    Written again after a loss it is the same.
    """
    path, spark = path.rstrip("/"), summary.sparkSession
    before = kept_summary(spark, path, version - 1)
    merged = summary if before is None else merge_summaries(before, summary)
    merged.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_SUMMARY}{version}")
    types = column_types(spark.read.parquet(f"{path}/{_SUMMARY}{version}")).collect()
    return {r["attribute"]: A(r["attribute_type"]) for r in types}
