"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. Where a token of the one and a token of the other end at the same byte, the text
falls into two parts that have nothing to do with each other. Of a stretch of tokens, the ends near its middle are looked
up among the other tokenizer's ends by bisection; the first that both have divides the stretch, and both halves are
treated alike. A stretch without such an end is a group: its tokens on either side spell the same bytes, and no smaller
part of them does.

The last tokens of a group's two sides are a link. How often a pair of ids is linked is counted over all documents.
Documents are dealt into blocks of bounded size; a block's pairs are added up before they are sent on, meet the totals by
an equi-join, and come back to their block, so no table of all pairs is sent anywhere.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import tokens
from recordloom.llm.tables import text_or_empty, written
from recordloom.llm.worker import held

#: Distinct links of a block's documents, added up, from which on a new block is begun.
BLOCK_LINKS = 1 << 19
#: Characters of texts that are aligned at once (a longer text is taken alone), and ends that a stretch looks up one by one.
CHARS_AT_ONCE = 200_000
PROBES = 12


def pieces_path() -> str:
    """The default vocabulary of pieces; every user of this module takes another path as well."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _divided(a: np.ndarray, b: np.ndarray, low: int, high: int) -> int:
    """Which of the ends ``a[low:high - 1]`` that ``b`` has, too, is the nearest to the middle, or -1 if there is none."""
    ends = a[low : high - 1]
    common = np.flatnonzero(b[np.searchsorted(b, ends)] == ends) + low
    return int(common[np.argmin(np.abs(common - (low + high) // 2))]) if len(common) else -1


def shared_cuts(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group, in order, how many of the tokens ``a`` and ``b`` (given by their rising ends) end by it.

    ``a_bounds`` and ``b_bounds`` say between which tokens the texts lie that are aligned at once; both sides of a text end
    together. All stretches of one depth are divided in one step: each looks up one end by bisection, first the one in
    its middle, then those beside it, farther and farther. After ``PROBES`` of them it looks all of its ends up.
    """
    cut_at = np.zeros(len(a), np.int64)
    low, high, b_low, b_high = a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]
    tried = np.zeros(len(low), np.int64)
    while len(low):
        # a stretch with one token on a side is a group; so is one that has been looked through, marked below
        leaf = (high - low <= 1) | (b_high - b_low <= 1) | (tried < 0)
        cut_at[high[leaf & (high > low)] - 1] = b_high[leaf & (high > low)]
        low, high, b_low, b_high, tried = (x[~leaf] for x in (low, high, b_low, b_high, tried))
        aside = (tried + 1) // 2
        at = (low + high) // 2 - 1 + np.where(tried % 2, aside, -aside)
        inside = (at >= low) & (at < high - 1)
        at = np.where(inside, at, low)
        place = np.searchsorted(b, a[at])
        hit = inside & (b[place] == a[at])
        # with as many to both sides as half its tokens, all its ends have been looked up
        tried = np.where(~hit & (tried // 2 >= (high - low + 1) // 2), -1, tried + 1)
        for i in np.flatnonzero(~hit & (tried >= PROBES)):
            at[i] = _divided(a, b, low[i], high[i])
            hit[i] = at[i] >= 0
            place[i] = np.searchsorted(b, a[at[i]]) if hit[i] else 0
            tried[i] = -1
        new = np.zeros(int(hit.sum()), np.int64)
        left, right = at[hit] + 1, place[hit] + 1
        low, high, b_low, b_high, tried = (
            np.concatenate(x)
            for x in (
                (low[~hit], low[hit], left), (high[~hit], left, high[hit]), (b_low[~hit], b_low[hit], right),
                (b_high[~hit], right, b_high[hit]), (tried[~hit], new, new),
            )
        )
    cuts = np.flatnonzero(cut_at)
    return cuts + 1, cut_at[cuts]


class Aligned(NamedTuple):
    """A text's ids by both tokenizers, and how many of them end by each of its groups."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray

    def groups(self) -> Iterator[tuple[list[int], list[int]]]:
        a, b = self.a.tolist(), self.b.tolist()
        for (i, j), (k, m) in pairwise([(0, 0), *zip(self.a_cuts.tolist(), self.b_cuts.tolist(), strict=True)]):
            yield a[i:k], b[j:m]


class Aligner:
    """Two tokenizers: byte-level ranks (A) and pieces with byte fallback (B)."""

    def __init__(self, ranks: str, pieces: str):
        import sentencepiece

        self._encoder = tokens.Encoder(ranks)
        with open(ranks, "rb") as lines:
            a_bytes = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, lines)}
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self._b_bytes = [self._piece_bytes(i) for i in range(len(self._pieces))]
        self.a_size, self.b_size = max(a_bytes) + 1, len(self._b_bytes)
        self._a_lengths = np.array([len(a_bytes.get(i, b"")) for i in range(self.a_size)])
        self._b_lengths = np.array([len(b) for b in self._b_bytes])
        # ids as text with what comes behind them: of A a comma or a bar, of B a comma or a semicolon
        self._texts = np.array([f"{i}{c}".encode() for n, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for c in ends for i in range(n)])

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._pieces.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self._pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids of a space and the text; none if one of them does not spell these bytes."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        whole = (" " + text).encode()
        a = np.frombuffer(self._encoder.encode_as_text(" " + text), "<u4").astype(np.int64)
        ids = self._pieces.encode(text)
        # ranks spell any bytes, so their length tells
        same = self._a_lengths[a].sum() == len(whole) and b"".join(map(self._b_bytes.__getitem__, ids)) == whole
        return (a, np.array(ids, np.int64)) if same else (none, none)

    def align(self, texts: Sequence[str]) -> Iterator[Aligned]:
        """Each text aligned; some are taken at once."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and chars < CHARS_AT_ONCE:
                chars += len(texts[stop])
                stop += 1
            ids = [self._encode(t) for t in texts[start:stop]]
            a, b = (np.concatenate([pair[side] for pair in ids]) for side in (0, 1))
            a_bounds, b_bounds = (np.cumsum([0, *[len(pair[side]) for pair in ids]]) for side in (0, 1))
            a_cuts, b_cuts = shared_cuts(np.cumsum(self._a_lengths[a]), np.cumsum(self._b_lengths[b]), a_bounds, b_bounds)
            within = np.searchsorted(a_cuts, a_bounds, side="right")
            for i, (own_a, own_b) in enumerate(ids):
                part = slice(within[i], within[i + 1])
                yield Aligned(own_a, own_b, a_cuts[part] - a_bounds[i], b_cuts[part] - b_bounds[i])
            start = stop

    def listed(self, text: Aligned) -> bytes:
        """The groups as text: ids of either side joined by commas, sides by a bar, groups by semicolons."""
        a, b, a_cuts, b_cuts = text
        if not len(a):
            return b""
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_cuts - 1] = b_last[b_cuts - 1] = True
        # a token comes behind those of its side, and those of the other side's groups before its own or, of B, up to it
        group = np.cumsum(a_last) - a_last
        place = np.arange(len(a)) + np.append(0, b_cuts)[group]
        order = np.empty(len(a) + len(b), np.int64)
        order[place] = a + self.a_size * a_last
        beside = a_cuts[np.cumsum(b_last) - b_last]
        order[np.arange(len(b)) + beside] = 2 * self.a_size + b + self.b_size * b_last
        return self._texts[order].tobytes().replace(b"\0", b"")[:-1]

    def links(self, text: Aligned) -> np.ndarray:
        """A number for the pair of ids of each link."""
        return text.a[text.a_cuts - 1] * self.b_size + text.b[text.b_cuts - 1]


def aligner(ranks: str, pieces: str) -> Aligner:
    """The aligner that this Python worker holds, of these files."""
    return held((Aligner, ranks, pieces), lambda: Aligner(ranks, pieces))


def align(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """``docs`` with ``groups``: for each group the ids ``a`` and ``b`` of its tokens, in the order of the text.

    A space goes before the text. Null and empty texts, and texts that one of the tokenizers does not spell byte by byte,
    have no groups. All rows and columns stay as they are, but for a column of the same name; an empty table stays empty.
    """
    ranks, pieces = ranks or tokens.vocabulary_path(), pieces or pieces_path()
    side = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("a", side), ("b", side)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(ranks, pieces)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            out = [[{"a": a, "b": b} for a, b in text.groups()] for text in both.align(texts)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], [*batch.schema.names[:-1], "groups"])

    keep = [c for c in docs.columns if c != "groups"]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("~text"))
    return chosen.mapInArrow(run, f"{fields}groups array<struct<a: array<int>, b: array<int>>>")


# --- counts over all documents --------------------------------------------------------------------------------------

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """One row per document: its ``block``, its counts and digest, and its distinct ``links`` with how often it ``has`` them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(ranks, pieces)
        block, full = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for text in both.align(batch.column(1).to_pylist()):
                links, has = np.unique(both.links(text), return_counts=True)
                if full > BLOCK_LINKS:
                    block, full = block + 1, 0
                full += len(links)
                digest = hashlib.sha256(both.listed(text)).hexdigest() if len(text.a) else ""
                counts = (len(text.a), len(text.b), len(text.a_cuts), int(has.sum()))
                rows.append((block, *counts, digest, links.astype("<i8").tobytes(), has.astype("<i4").tobytes()))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "block", *_COUNTS, "groups_sha256", "links", "has"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, block long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, links binary, has binary"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, fields)


def _block_links(stored: DataFrame) -> DataFrame:
    """``block``, ``link`` and the number ``n`` of its occurrences in documents that follow each other in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: int | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            links, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(place, np.concatenate([x for _, x in held])).astype(np.int64)
            held.clear()
            for i in range(0, len(links), 100_000):
                part = slice(i, i + 100_000)
                columns = [pa.array(np.full(len(links[part]), block)), pa.array(links[part]), pa.array(n[part])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "link", "n"])

        for batch in batches:
            for own, links, has in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (own != block or size > BLOCK_LINKS):
                    yield from flush()
                    size = 0
                block = own
                held.append((np.frombuffer(links, "<i8"), np.frombuffer(has, "<i4")))
                size += len(held[-1][0])
        if held:
            yield from flush()

    return stored.select("block", "links", "has").mapInArrow(run, "block long, link long, n long")


def link_counts(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of tokens, groups and links, and what all documents say of its links.

    ``n_best`` are the links whose pair of ids is linked as often as any pair with the same id of the pieces,
    ``count_sum`` adds up how often the pairs are linked in all documents, ``groups_sha256`` is the digest of the groups
    as text. Rows of one doc_id stay separate rows. Null and empty texts, and texts that one of the tokenizers does not
    spell byte by byte, have zeros and an empty digest. An empty table gives no rows.
    """
    ranks, pieces = ranks or tokens.vocabulary_path(), pieces or pieces_path()
    stored = written(_blocks(docs, ranks, pieces), "aligned")
    within = _block_links(stored)
    total = written(within.groupBy("link").agg(F.sum("n").alias("total")), "links")
    # pairs of one id of the pieces are at most as many as there are ranks
    piece = F.pmod("link", F.lit(aligner(ranks, pieces).b_size))
    best = total.groupBy(piece.alias("piece")).agg(F.max("total").alias("best"))
    judged = total.withColumn("piece", piece).join(best, "piece").select("link", "total", (F.col("total") == F.col("best")).alias("best"))
    back = within.select("block", "link").distinct().join(judged, "link").select("block", "link", "total", "best")
    names = ["doc_id", *_COUNTS, "groups_sha256", "n_best", "count_sum"]

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["link"].to_numpy())
        link, total, best = (known[c].to_numpy()[order] for c in ("link", "total", "best"))
        n_best, count_sum = [], []
        for links, has in zip(rows["links"].to_pylist(), rows["has"].to_pylist(), strict=True):
            at, has = np.searchsorted(link, np.frombuffer(links, "<i8")), np.frombuffer(has, "<i4").astype(np.int64)
            n_best.append(int(has[best[at]].sum()))
            count_sum.append(int((has * total[at]).sum()))
        counted = rows.select(names[:-2])
        return counted.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    kind = stored.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{n} {kind if n == 'doc_id' else 'string' if n == 'groups_sha256' else 'long'}" for n in names)
    return stored.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(look_up, fields)
