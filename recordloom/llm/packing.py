"""Packing into sequences of fixed capacity by minimum bin slack.

Documents are cut into pieces of full capacity and a remainder. What is planned is not the pieces but the multiset of
their lengths, which has at most ``capacity`` different values: with the longest length left in the window, a subset-sum
dynamic programme over bitsets finds the lengths that fill it closest to capacity, the path is followed back to how
often each length is used, and that window is repeated while the counts last. A piece then finds its place from its rank
among the pieces of its length. So the driver holds counts by length only, and no task holds more than one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.tables import text_or_empty, written
from recordloom.llm.tokens import encoder, vocabulary_path

CAPACITY = 2048
END_ID = 1
BUCKET_ROWS = 100_000

Pattern = dict[int, int]


def fill(counts: Mapping[int, int], room: int) -> Pattern:
    """The multiset of lengths, within their counts, whose sum comes closest to ``room`` from below.

    Bit s of a bitset says that sum s can be reached. Each length enters in powers of two of its count, longest first.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reached))
            reached |= (reached << (length * times)) & mask
            left -= times
            times *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    used: Pattern = {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= length * times
    return used


def plan_windows(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Windows as (times each length is used, how often the window is repeated), until all counts are used up."""
    left = {length: n for length, n in counts.items() if n > 0}
    windows = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fill(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[length] // n for length, n in pattern.items())
        windows.append((pattern, repeats))
        for length, n in pattern.items():
            left[length] -= n * repeats
            if not left[length]:
                del left[length]
    return windows


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, ``start``, ``length``, ``ids`` (bytes, 32 bits each, little-endian), ``doc_tokens``.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id`` alone. Rows with equal or
    null doc_id are documents of their own.
    """
    path = path or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            of, starts, lengths, ids, tokens = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                whole = encode(text) + end
                for at in range(0, len(whole), step):
                    piece = whole[at : at + step]
                    of.append(row)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    ids.append(piece)
                    tokens.append(len(whole) // 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(tokens, pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``capacity``.

    Sequences are numbered from 0, and a sequence's pieces follow each other without a gap. ``cut`` is read twice, so it
    should be a stored table. Pieces of one length are dealt into buckets by a hash of all their columns, so that ranks
    come from small groups; equal rows may change places among themselves. An empty table stays empty.
    """
    total = cut.count()
    buckets = total // BUCKET_ROWS + 1
    others = [c for c in cut.columns if c != "length"]
    dealt = cut.withColumn("~bucket", F.pmod(F.xxhash64(*[f"`{c}`" for c in others]), F.lit(buckets)))
    sizes = dealt.groupBy("length", "~bucket").agg(F.count("*").alias("~n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("~n").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"pieces must have lengths from 1 to {capacity}")

    # by length: the first rank of each window that uses it, how often, and where its pieces begin
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, repeats in plan_windows(counts, capacity):
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            spans.setdefault(length, []).append((taken[length], n, sequence, offset))
            taken[length] += n * repeats
            offset += n * length
        sequence += repeats
    found = {length: np.array(s, np.int64).T for length, s in spans.items()}

    before = Window.partitionBy("length").orderBy("~bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "~bucket", F.coalesce(F.sum("~n").over(before), F.lit(0)).alias("~first"))
    order = Window.partitionBy("length", "~bucket").orderBy(*[F.col(f"`{c}`") for c in others])
    ranked = dealt.join(firsts, ["length", "~bucket"]).withColumn("~rank", F.col("~first") + F.row_number().over(order) - 1)
    ranked = ranked.select(*[F.col(f"`{c}`") for c in cut.columns], "~rank")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("~rank").to_numpy(zero_copy_only=False)
            sequences, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                starts, times, first, offset = found[int(length)]
                at = np.searchsorted(starts, ranks[rows], "right") - 1
                within = ranks[rows] - starts[at]
                sequences[rows] = first[at] + within // times[at]
                offsets[rows] = offset[at] + within % times[at] * length
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequences), pa.array(offsets)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(settle, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids and their places."""
    return place(written(pieces(docs, capacity, path, end_id), "pieces"), capacity)


def pack_digests(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """As ``pack``, with the ids' crc32 in their stead: what is stored and shuffled is a few numbers per piece."""
    cut = pieces(docs, capacity, path, end_id)
    digests = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return place(written(digests, "pieces"), capacity)
