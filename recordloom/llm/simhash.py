"""SimHash near-duplicates by a hierarchical index over Gray order.

A fingerprint has 64 bits, each the majority over a document's shingles. Fingerprints that differ in at most ``bits``
places agree on at least two of ``bits + 2`` blocks of their bits, so the upper nodes of the index are masked bit
patterns of two blocks: each fingerprint is dealt to one node per pair of blocks, and nodes with one member go. A node
with too many members is divided again by pairs of blocks of its free bits. Within a node the fingerprints are sorted by
Gray rank, runs of neighbours share a masked pattern that is factored out into the level above, and a search adds up
the differences from the top down and leaves out whole runs as soon as they exceed the bound.

Equal fingerprints are one from the start and a node yields links that span its components, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.components import components
from recordloom.llm.tables import text_or_empty, written
from recordloom.llm.worker import let_go

SEED = 42
SHINGLE = 3
BITS = 2
NODE_MEMBERS = 20_000
FANOUT = 8
SMALL_NODE = 9
SHINGLES_AT_ONCE = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of a text's shingles of lower-cased words; zero where it has no words.

    A text with fewer words than a shingle is one shingle. Repeated shingles count as often as they occur.
    """
    words = text.lower().split()
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*[words[i : len(words) - shingle + 1 + i] for i in range(shingle)], strict=True))
    set_bits, total = np.zeros(64, np.int64), 0
    while part := [xxhash.xxh64_intdigest(s, SEED) for s, _ in zip(shingles, range(SHINGLES_AT_ONCE), strict=False)]:
        octets = np.array(part, ">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
        if len(part) < SHINGLES_AT_ONCE:
            break
    return int(np.packbits(2 * set_bits > total).view(">i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of ``text`` (null: empty) as a signed long. ``docs`` may have any other columns."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            marks = [fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.int64())], [*batch.schema.names[:-1], name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    octets = text_or_empty().cast("binary").alias("~octets")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], octets).mapInArrow(add, f"{fields}, `{name}` long")


# --- the index within a node ----------------------------------------------------------------------------------------


def _levels(marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, own mask) of each level, from the top to the fingerprints; a mask leaves out what the level above has."""
    ones, zeros = marks, ~marks
    levels = [(marks, np.full(len(marks), ~np.uint64(0)))]
    while len(levels[-1][0]) > FANOUT:
        at = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        levels.append((ones, ones | zeros))
    levels.reverse()
    out = [levels[0]]
    for (_, above), (pattern, mask) in zip(levels, levels[1:], strict=False):
        out.append((pattern, mask & ~np.repeat(above, FANOUT)[: len(mask)]))
    return out


def search(marks: np.ndarray, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in ``queries``, position in ``marks``) that differ in at most ``bits`` places; marks in Gray order."""
    levels = _levels(marks)
    pattern, mask = levels[0]
    who = np.repeat(np.arange(len(queries)), len(pattern))
    node = np.tile(np.arange(len(pattern)), len(queries))
    off = np.zeros(len(who), np.int64)
    for depth, (pattern, mask) in enumerate(levels):
        if depth:
            size = len(pattern)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            who, off = np.repeat(who, FANOUT), np.repeat(off, FANOUT)
            there = node < size
            who, node, off = who[there], node[there], off[there]
        off = off + np.bitwise_count((queries[who] ^ pattern[node]) & mask[node])
        near = off <= bits
        who, node, off = who[near], node[near], off[near]
    return who, node


def spanning_links(marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``bits`` connect; ``marks`` are distinct and in Gray order."""
    root = np.arange(len(marks))
    for start in range(0, len(marks), 256):
        who, other = search(marks, marks[start : start + 256], bits)
        a, b = who + start, other
        while True:
            left, right = root[a], root[b]
            if (left == right).all():
                break
            least = np.minimum(left, right)
            np.minimum.at(root, left, least)
            np.minimum.at(root, right, least)
            while (root[root] != root).any():
                root = root[root]
    child = np.flatnonzero(root != np.arange(len(marks)))
    return marks[child], marks[root[child]]


def _node_links(bits: int):
    """Links of all nodes of a partition, which comes sorted by node and Gray rank; one node is in memory at a time."""

    def links(marks: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.diff(np.append(starts, len(marks)))
        of = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= SMALL_NODE, sizes)
        for step in range(1, SMALL_NODE):
            a, b = marks[:-step], marks[step:]
            near = (of[:-step] == of[step:]) & small[step:] & (np.bitwise_count(a ^ b) <= bits)
            yield a[near], b[near]
        for i in np.flatnonzero(sizes > SMALL_NODE):
            yield spanning_links(marks[starts[i] : starts[i] + sizes[i]], bits)

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1]:
            new = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            for a, b in links(rows[2].view(np.uint64), np.flatnonzero(new)):
                if len(a):
                    columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held = np.empty((3, 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
                rows = np.concatenate([held, rows], axis=1)
                # all nodes but the last one are complete; that one may go on in the next batch
                other = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
                cut = other[-1] + 1 if len(other) else 0
                yield from whole(rows[:, :cut])
                held = rows[:, cut:]
        yield from whole(held)

    return run


# --- the upper nodes ------------------------------------------------------------------------------------------------


def pair_masks(bits: int, taken: int = 0) -> list[int]:
    """Masks of two blocks each, of the bits that ``taken`` leaves free, added to it; none if too few bits are free."""
    free = [i for i in range(64) if not taken >> i & 1]
    blocks = bits + 2
    if len(free) < blocks:
        return []
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << p for p in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [taken | a | b for a, b in combinations(masks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _gray_rank(mark: Column) -> Column:
    """The rank of a bit string in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        mark = mark.bitwiseXOR(F.shiftrightunsigned(mark, shift))
    return mark


def fingerprint_links(marks: DataFrame, bits: int = BITS, members: int = NODE_MEMBERS) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct ``fingerprint`` values of ``marks`` within ``bits``, and no others.

    ``marks`` should be a stored table. Nodes of more than ``members`` fingerprints are divided, which loses no link. At
    the last level so few bits are free that a node is small.
    """
    spark: SparkSession = marks.sparkSession
    level = {m: None for m in pair_masks(bits)}
    dealt = marks.select("fingerprint", F.explode(F.array(*[F.lit(_signed(m)) for m in level])).alias("mask"))
    found = None
    while True:
        node = dealt.select("fingerprint", "mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("pattern"))
        sizes = node.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1")
        last = not any(pair_masks(bits, m) for m in level)
        sized = node.join(sizes, ["mask", "pattern"])
        links = (
            (sized if last else sized.where(F.col("n") <= members))
            .select("mask", "pattern", "fingerprint")
            .repartition("mask", "pattern")
            .sortWithinPartitions("mask", "pattern", _gray_rank(F.col("fingerprint")))
            .mapInArrow(_node_links(bits), "a long, b long")
        )
        found = links if found is None else found.union(links)
        # only the masks of nodes that are too large go on, at most as many as this level has
        large = [] if last else sizes.where(F.col("n") > members).select("mask").distinct().collect()
        if not large:
            return found
        below = {m: pair_masks(bits, m) for m in level if _signed(m) in {r["mask"] for r in large}}
        children = spark.range(1).select(
            F.inline(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(c)).alias("child")) for m, cs in below.items() for c in cs]))
        )
        hot = sized.where(F.col("n") > members).select("fingerprint", "mask")
        dealt = written(hot.join(F.broadcast(children), "mask").select("fingerprint", F.col("child").alias("mask")).distinct(), "node")
        level = {c: None for cs in below.values() for c in cs}


def near_duplicate_groups(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """``fingerprint``, ``root`` and ``component_id``, one row for each distinct fingerprint of ``marked``.

    ``marked`` is a stored table with doc_id and fingerprint. ``component_id`` is the smallest doc_id that can be reached
    over links, and null only if no document of the component has an id. ``root`` is the component's least fingerprint.
    """
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(fingerprint_links(distinct, bits))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "fingerprint", "root", "component_id"
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``fingerprint`` (16 hex digits) and ``component_id``.

    A null or empty text has fingerprint zero, linked like any other. Rows with equal doc_id stay separate rows; a null
    doc_id is never the smallest. An empty table gives no rows.
    """
    marked = written(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"), "marked")
    groups = near_duplicate_groups(marked, bits)
    return marked.join(groups, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates, all columns as they are.

    It is the row with the smallest doc_id; a null one counts as the largest, of equal ones the first row stays. A null
    or empty text has fingerprint zero, linked like any other. An empty table stays empty.
    """
    stored = written(docs.withColumn("~row", F.monotonically_increasing_id()), "stored")
    marked = with_fingerprint(stored.select("~row", "doc_id", "text"), shingle).select("~row", "doc_id", "fingerprint")
    marked = written(marked, "marked")
    # copies are narrowed down to their first row before components are
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "~row")
    first = marked.groupBy("fingerprint").agg(F.min(order).alias("first"))
    roots = near_duplicate_groups(marked, bits).select("fingerprint", "root")
    stay = first.join(roots, "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select("first.~row")
    return stored.join(stay, "~row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
