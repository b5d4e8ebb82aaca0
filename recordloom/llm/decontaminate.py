"""Benchmark decontamination by q-gram lemma filtering.

If a passage of a text is within e edits of an item of m characters, the two share at least ``m + 1 - q - q * e``
q-grams, whose diagonals (place in the text less place in the item) differ by at most e. So the shared q-grams are
counted in bands of diagonals that are twice as wide as that and overlap by half, bands with too few are dropped, and
the rest are verified by an alignment that is confined to the band.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tables import text_or_empty
from recordloom.llm.worker import let_go

Q = 8
EDIT_SHARE = 0.1
#: Characters of benchmark text that one pass over the documents carries; more of it takes more passes.
BLOCK_CHARS = 1_000_000
#: Characters of a document that are hashed at once.
CHUNK_CHARS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Match(NamedTuple):
    item: int
    start: int
    end: int
    edits: int


def code_points(text: str) -> np.ndarray:
    """Code points, A-Z in lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return points + 32 * ((points >= 65) & (points <= 90)).astype(np.uint32)


def _hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each q-gram, by doubling: pairs of characters, pairs of these, and so on (q is a power of two)."""
    hashed, width, factor = points.astype(np.uint64), 1, int(BASE)
    while width < Q:
        hashed = hashed[:-width] * np.uint64(factor) + hashed[width:]
        width *= 2
        factor = factor * factor % (1 << 64)
    return hashed


def edit_budget(length: int) -> int:
    """A tenth of an item's characters, and so few that the lemma still asks for a shared q-gram."""
    return max(0, min(int(length * EDIT_SHARE), (length - Q) // Q))


class Index:
    """The q-grams of a block of items, and the items that are shorter than one, which are looked for as they are."""

    def __init__(self, texts: Sequence[str]):
        short: dict[str, list[int]] = {}
        for which, text in enumerate(texts):
            if 0 < len(text) < Q:
                short.setdefault(text.translate(LOWER), []).append(which)
        self.short = ahocorasick.Automaton() if short else None
        for text, found in short.items():
            self.short.add_word(text, (len(text), found))
        if short:
            self.short.make_automaton()
        self.items = [code_points(t) for t in texts]
        length = np.array([len(p) for p in self.items], np.int64)
        self.budget = np.array([edit_budget(n) for n in length.tolist()], np.int64)
        self.needed = np.maximum(1, length + 1 - Q - Q * self.budget)
        grams = [_hashes(p) if len(p) >= Q else np.empty(0, np.uint64) for p in self.items]
        hashed = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(hashed, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.times = np.unique(hashed[order], return_index=True, return_counts=True)
        bits = min(26, max(16, int(64 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys * BASE) >> self.shift] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in it, diagonal) of every q-gram that the text shares with an item."""
        items, places, diagonals = [], [], []
        for start in range(0, max(0, len(points) - Q + 1), CHUNK_CHARS):
            hashed = _hashes(points[start : start + CHUNK_CHARS + Q - 1])
            at = np.flatnonzero(self.seen[(hashed * BASE) >> self.shift])
            key = np.searchsorted(self.keys, hashed[at])
            key[key == len(self.keys)] = 0
            same = self.keys[key] == hashed[at]
            at, key = at[same], key[same]
            times = self.times[key]
            shift = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row = np.repeat(self.first[key], times) + shift
            items.append(self.item[row])
            places.append(self.place[row])
            diagonals.append(np.repeat(at + start, times) - self.place[row])
        if not items:
            return (np.empty(0, np.int64),) * 3
        return np.concatenate(items), np.concatenate(places), np.concatenate(diagonals)

    def _equal(self, points: np.ndarray, which: int, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        """The alignment without edits, if all of an item's q-grams lie on one diagonal and so do its characters."""
        item = self.items[which]
        start, hits = np.unique(diagonals, return_counts=True)
        for at in start[hits >= len(item) + 1 - Q].tolist():
            if at >= 0 and np.array_equal(points[at : at + len(item)], item):
                return at, at + len(item), 0
        return None

    def matches(self, text: str) -> list[Match]:
        """The best match of each item in each stretch of the text that it covers, in order of item and start."""
        found = []
        for end, (length, short) in self.short.iter(text.translate(LOWER)) if self.short else ():
            found += [Match(which, end + 1 - length, end + 1, 0) for which in short]
        return _best(found + self._long_matches(text))

    def _long_matches(self, text: str) -> list[Match]:
        """Matches of items of a q-gram or more; they may overlap."""
        points = code_points(text)
        if len(points) < Q or not len(self.keys):
            return []
        item, place, diagonal = self.hits(points)
        if not len(item):
            return []
        # an item with too few hits anywhere can't have enough in a band
        enough = np.bincount(item, minlength=len(self.items))[item] >= self.needed[item]
        item, place, diagonal = item[enough], place[enough], diagonal[enough]
        if not len(item):
            return []
        width = self.budget[item] + 1
        band = np.floor_divide(diagonal, width)
        lowest = int(band.min(initial=0)) - 1
        span = int(band.max(initial=0)) - lowest + 1
        keys = item * span + band - lowest
        both = np.concatenate([keys, keys - 1])
        found_keys, counts = np.unique(both, return_counts=True)
        found = []
        for key in found_keys[counts >= self.needed[found_keys // span]].tolist():
            which, number = key // span, key % span + lowest
            mine = (keys == key) | (keys == key + 1)
            # a q-gram that the text repeats counts once: the lemma is about places in the item
            if len(np.unique(place[mine])) < self.needed[which]:
                continue
            e = int(self.budget[which])
            match = self._equal(points, which, diagonal[mine]) or align(points, self.items[which], number * (e + 1), 2 * (e + 1), e)
            if match is not None:
                found.append(Match(which, *match))
        return found


def align(text: np.ndarray, item: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the text's passage nearest to ``item``, if it is within ``budget`` edits.

    The passage may begin anywhere in the diagonals ``low`` to ``low + width`` and may leave them by ``budget``. Of
    passages with as few edits the first that ends counts, and of its beginnings the last.
    """
    first, size = low - budget, width + 2 * budget
    columns = np.arange(size)
    far = np.int64(1 << 30)
    outside = np.full(size + len(item), 0xFFFFFFFF, np.uint32)
    left, right = max(first, 0), min(first + size + len(item), len(text))
    if left < right:
        outside[left - first : right - first] = text[left:right]
    inside = (columns + first >= 0) & (columns + first <= len(text))
    # costs and beginnings share one number, so that a minimum carries the beginning along; later beginnings are less
    base = np.int64(1 << 20)
    row = np.where(inside, base - 1 - columns, far * base)
    slope = columns * base
    above = np.full(size, far * base)
    for i, c in enumerate(item.tolist()):
        # staying on a diagonal takes one character of both; column j + 1 of the row above takes one of the item only
        np.add(row[1:], base, out=above[:-1])
        best = np.minimum(row + (outside[i : i + size] != c) * base, above)
        row = np.minimum.accumulate(best - slope) + slope
        if i % 16 == 15 and row.min() >= (budget + 1) * base:
            return None
    ends = columns + first + len(item)
    row = np.where(ends <= len(text), row, far * base)
    at = int((row // base).argmin())
    edits, begin = int(row[at] // base), int(base - 1 - row[at] % base)
    if edits > budget:
        return None
    return begin + first, int(ends[at]), edits


def _best(found: list[Match]) -> list[Match]:
    """Of matches of one item that overlap, the one with the fewest edits, then the first."""
    out: list[Match] = []
    end = 0
    for match in sorted(found):
        if out and out[-1].item == match.item and match.start < end:
            end = max(end, match.end)
            if match.edits < out[-1].edits:
                out[-1] = match
        else:
            out.append(match)
            end = match.end
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most ``limit`` characters, or of one longer item; empty ones are left out."""
    block: list[tuple[object, str]] = []
    chars = 0
    rows = benchmark.where(F.length("text") > 0).select("item_id", "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if block and chars + len(row["text"]) > limit:
            yield block
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    if block:
        yield block


def _matched(docs: DataFrame, keep: Sequence[str], block: list[tuple[object, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index = Index([text for _, text in block])
        number = pa.array(range(len(block)), pa.int32())
        for batch in batches:
            of, found = [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for match in index.matches(text):
                    of.append(row)
                    found.append(match)
            kept = [batch.column(i).take(pa.array(of, pa.int64())) for i in range(batch.num_columns - 1)]
            parts = [
                number.take(pa.array([m.item for m in found], pa.int64())),
                *[pa.array([m[i] for m in found], pa.int32()) for i in (1, 2, 3)],
            ]
            yield pa.RecordBatch.from_arrays([*kept, *parts], [*batch.schema.names[:-1], "~number", "start", "end", "edits"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("~text"))
    ids = F.array(*[F.lit(item) for item, _ in block])
    return (
        chosen.mapInArrow(run, f"{fields}`~number` int, start int, end int, edits int")
        .withColumn("item_id", F.element_at(ids, F.col("~number") + 1))
        .drop("~number")
    )


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``item_id``, ``start``, ``end`` and ``edits`` of each passage near a benchmark item.

    Near means within ``edit_budget`` edits, A-Z in lower case; offsets are code points of the whole text, the end
    exclusive. Rows of ``docs`` are judged one by one, so repeated rows give repeated rows; null and empty texts have no
    passages, neither have items that are null or empty. Items shorter than a q-gram are found as they are. Repeated items are all reported. An empty table
    of either kind gives no rows.

    The benchmark is a list of questions to look for, read in blocks of bounded size; each block is a pass of its own.
    """
    out = None
    for block in blocks(benchmark):
        part = _matched(docs, keep, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = benchmark.schema["item_id"].dataType
        none = docs.select(*[F.col(f"`{c}`") for c in keep]).where(F.lit(False))
        return none.select("*", *[F.lit(0).alias(c) for c in ("start", "end", "edits")], F.lit(None).cast(kind).alias("item_id"))
    return out


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no passage is near a benchmark item."""
    out = docs
    for block in blocks(benchmark):
        texts = [text for _, text in block]

        def clean(batches: Iterator[pa.RecordBatch], texts: list[str] = texts) -> Iterator[pa.RecordBatch]:
            let_go()
            index = Index(texts)
            for batch in batches:
                at = batch.schema.names.index("text")
                yield batch.filter(pa.array([not index.matches(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
