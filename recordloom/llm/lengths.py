"""Token counts by an exact length histogram.

Documents are counted by their encoded length; sums over all longer lengths then answer totals, quantiles and truncated
totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.tables import text_or_empty
from recordloom.llm.tokens import encoder, vocabulary_path

BLOCK = 256


def token_lengths(docs: DataFrame, path: str | None = None, extra: int = 0) -> DataFrame:
    """One row per document: ``length``, the ids of its whole text plus ``extra``. A null text has no ids of its own."""
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            lengths = [len(encode(t)) // 4 + extra for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["length"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(count, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``length`` and ``documents``, the number of documents of that length. An empty table gives no rows."""
    return lengths.groupBy("length").agg(F.count("*").alias("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs.

    ``tokens``: of the documents of length L. ``documents_from``, ``tokens_from``: of those of length L or more.
    ``truncated_total``: tokens left if every document is cut to L. ``share_within``: documents of length L or less, as
    a share of all, so that the quantile q is the least L whose share is q or more.

    The histogram has a row per distinct length, however many documents there are. It is summed in blocks of ``BLOCK``
    lengths, so that only one row per block meets in one task.
    """
    with_block = histogram.select(
        "length",
        "documents",
        (F.col("length") * F.col("documents")).alias("tokens"),
        F.floor(F.col("length") / BLOCK).alias("block"),
    )
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        with_block.groupBy("block")
        .agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("documents_above"),
            F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("tokens_above"),
            F.sum("d").over(every).alias("all_documents"),
            F.sum("t").over(every).alias("all_tokens"),
        )
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        with_block.join(blocks, "block")
        .withColumn("documents_from", F.col("documents_above") + F.sum("documents").over(within))
        .withColumn("tokens_from", F.col("tokens_above") + F.sum("tokens").over(within))
        .select(
            "length",
            "documents",
            "tokens",
            "documents_from",
            "tokens_from",
            (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("documents_from")).alias("truncated_total"),
            (1 - (F.col("documents_from") - F.col("documents")) / F.col("all_documents")).alias("share_within"),
        )
    )


def totals_at(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``limit``, of any value: documents and tokens of that length or more, and the total after truncation.

    ``limits`` is small by its nature (context sizes to choose from), one row per limit; nulls are left out.
    """
    wanted = limits.where(F.col("limit").isNotNull()).select("limit").distinct()
    at = wanted.join(sums, F.col("length") >= F.col("limit"), "left").groupBy("limit").agg(
        F.coalesce(F.max("documents_from"), F.lit(0)).alias("documents_from"),
        F.coalesce(F.max("tokens_from"), F.lit(0)).alias("tokens_from"),
    )
    total = sums.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("all_tokens"))
    return at.join(F.broadcast(total)).select(
        "limit",
        "documents_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("limit") * F.col("documents_from")).alias("truncated_total"),
    )
