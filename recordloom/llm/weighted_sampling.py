"""Document fingerprints by consistent weighted sampling.

A document is the bag of its words, each word weighted by how often it occurs. For each of ``SAMPLES`` samples a word has
two gamma variables r and c and a uniform variable b, all functions of the word and the sample's number. With weight S
they give t = floor(ln S / r + b) and ln a = ln c - r (t + 1 - b), and the word with the least a is the sample. Two
documents draw the same word at the same t with a probability that is the generalised Jaccard similarity of their bags:
the sum of the smaller weights over the sum of the larger ones.

As a follows from word and t, equal samples have equal least values, so a fingerprint holds these values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.tables import ascii_lower, text_or_empty

SAMPLES = 32
SEED = 20
#: White space between words: fixed values.
BETWEEN = r"[ \t\n\x0B\f\r]+"
BUCKET_ROWS = 2_000


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number between 0 and 1, without both, from some bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) * F.lit(1.0 / (1 << width))


def sample_value(word: Column, weight_log: Column, sample: int) -> Column:
    """ln a of a word (given as a hash) in one sample, for the logarithm of its weight."""
    first, second = F.xxhash64(word, F.lit(SEED + 2 * sample)), F.xxhash64(word, F.lit(SEED + 2 * sample + 1))
    r = -F.ln(_uniform(first, 0, 32) * _uniform(first, 32, 32))
    log_c = F.ln(-F.ln(_uniform(second, 0, 21) * _uniform(second, 21, 21)))
    b = _uniform(second, 42, 22)
    return log_c - r * (F.floor(weight_log / r + b) + F.lit(1.0) - b)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints; two documents without words are alike, with one only they aren't."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda equal: equal)) / F.lit(float(SAMPLES))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def fingerprints(texts: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """``keys`` with, for each text column of ``versions``, its samples as an array of the same name (null: no words).

    ``keys`` tell rows apart, and ``texts`` should be partitioned by the first of them: words are counted and samples
    drawn where the rows are. Words that are as frequent in all versions are drawn once.
    """
    def words(version: str) -> Column:
        counts = [F.lit(1 if version == v else 0).alias(f"n{i}") for i, v in enumerate(versions)]
        found = F.filter(F.split(ascii_lower(F.col(version)), BETWEEN), lambda w: w != "")
        return F.transform(found, lambda w: F.struct(F.xxhash64(w).alias("word"), *counts))

    counted = (
        texts.select(*keys, F.explode(F.concat(*[words(v) for v in versions])).alias("w"))
        .groupBy(*keys, F.col("w.word").alias("word"))
        .agg(*[F.sum(F.col(f"w.n{i}")).alias(f"n{i}") for i in range(len(versions))])
    )
    logs = counted.select(*keys, "word", *[F.when(F.col(f"n{i}") > 0, F.ln(f"n{i}")).alias(f"l{i}") for i in range(len(versions))])
    drawn = []
    for i in range(len(versions)):
        for s in range(SAMPLES):
            drawn.append(F.min(sample_value(F.col("word"), F.col(f"l{i}"), s)).alias(f"s{i}_{s}"))
    drawn = logs.groupBy(*keys).agg(*drawn)
    return drawn.select(
        *keys,
        *[
            F.when(F.col(f"s{i}_0").isNotNull(), F.array(*[F.col(f"s{i}_{s}") for s in range(SAMPLES)])).alias(v)
            for i, v in enumerate(versions)
        ],
    )


def printed(samples: Column) -> Column:
    """A fingerprint as text, eight hex digits per sample; empty where there are no words."""
    return F.coalesce(
        F.array_join(F.transform(samples, lambda s: F.substring(F.lower(F.lpad(F.hex(F.xxhash64(s)), 16, "0")), 9, 8)), ""), F.lit("")
    )


# --- each document beside the next one ------------------------------------------------------------------------------

MOST_BUCKETS = 10_000


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and ``text`` with ``bucket``, ``at`` (the place in it), ``next_text`` and ``copy``, in order of doc_id.

    Rows of one doc_id are ordered by a hash of their text, a null doc_id comes first, the last document's next one is
    the first. Buckets are ranges of ids between quantiles, of some ``BUCKET_ROWS`` rows each, and every bucket holds a
    copy of the next one's first row at its end, marked by ``copy``: so neighbours are found within buckets, in one
    shuffle. The driver sees one row per bucket.
    """
    from pyspark.ml.feature import Bucketizer

    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), number.alias("number")
    ).withColumn("hash", F.xxhash64("text"))
    wanted = min(MOST_BUCKETS, rows.count() // BUCKET_ROWS + 1)
    cuts = rows.approxQuantile("number", [i / wanted for i in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol="number", outputCol="range").transform(rows)
        dealt = dealt.select("doc_id", "text", "hash", F.col("range").cast("int").alias("bucket"))
    else:
        dealt = rows.select("doc_id", "text", "hash", F.lit(0).alias("bucket"))
    firsts = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect())
    # the copy of a bucket's first row goes to the bucket before it, and that of the very first to the last bucket
    heads = [
        F.struct(
            F.lit(first["doc_id"]).cast("long").alias("head_id"),
            F.lit(first["hash"]).cast("long").alias("head_hash"),
            F.lit(firsts[i - 1][0]).alias("before"),
        )
        for i, (_, first) in enumerate(firsts)
    ]
    together = dealt.withColumn("copy", F.lit(False))
    if heads:
        listed = docs.sparkSession.range(1).select(F.inline(F.array(*heads)))
        is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash"))
        copies = dealt.drop("bucket").join(F.broadcast(listed), is_head)
        together = together.unionByName(copies.select("doc_id", "text", "hash", F.col("before").alias("bucket"), F.lit(True).alias("copy")))
    # known not to be null, a bucket needs no filter, and all that is made of the rows shares one exchange of the texts
    together = together.withColumn("bucket", F.coalesce("bucket", F.lit(0)))
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "hash")
    return together.select(
        "bucket", F.row_number().over(order).alias("at"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "copy"
    )


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and how like they and the next one's are.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many of the next
    document, or all if there are fewer. A null text is empty, an empty one has no words and an empty fingerprint; see
    ``in_order`` for ties. The only document is its own next one. An empty table gives no rows.
    """
    chars = F.length("text")
    quarter = F.floor(chars / 4).cast("int")
    rows = in_order(docs).select(
        "bucket",
        "at",
        "copy",
        "doc_id",
        chars.cast("long").alias("n_chars"),
        "text",
        F.concat(F.substring("text", F.lit(1), chars - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)).alias("edited"),
    )
    drawn = fingerprints(rows, ["bucket", "at"], ["text", "edited"])
    following = Window.partitionBy("bucket").orderBy("at")
    return (
        rows.select("bucket", "at", "copy", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
        .join(drawn, ["bucket", "at"], "left")
        .withColumn("next", F.lead("text").over(following))
        .where(~F.col("copy"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            printed(F.col("text")).alias("fingerprint"),
            printed(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("text"), F.col("edited")).alias("near_edited"),
            likeness(F.col("text"), F.col("next")).alias("near_next"),
        )
    )
