"""Quality by the votes of the nearest labelled documents in a space of latent semantics.

A text's terms are its three-byte sequences in lower case and the order of the kinds of its characters (runs of capitals,
small letters, digits, each sign), hashed to a fixed number, weighted by their rarity over all documents, and the share of
words that repeat one before. The leading axes of the labelled documents' terms, found by subspace iteration whose
products are added up in Spark, span the space. The labelled documents' vectors, bounded in number, are sent to every
task, which multiplies them with the vectors of all its documents block by block. The nearest vote with their label; a
vote counts by the fourth power of its cosine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tables import held_out, text_or_empty, written
from recordloom.llm.worker import let_go

#: The expected number of labelled documents that the axes are fitted on and that vote, drawn by a hash of the id.
LABELLED = 20_000
HASH_BITS = 13
HASHED = 1 << HASH_BITS
#: Shares of words that are equal to the one before, that came before at all, and that came up to eight words before.
REPEATS = 3
REPEAT_WEIGHTS = np.array([1.0, 0.5, 0.5])
REACH = 8
TERMS = HASHED + REPEATS
AXES = 64
ROUNDS = 5
NEIGHBOURS = 15
POWER = 4
#: Documents whose cosines with all labelled vectors are in memory at once, and bytes of a text that are.
BLOCK = 256
STRETCH = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)
_OCTETS = np.arange(256, dtype=np.uint64)
_CAPITAL = (_OCTETS >= ord("A")) & (_OCTETS <= ord("Z"))
_LOWER = np.where(_CAPITAL, _OCTETS + np.uint64(32), _OCTETS)
_SMALL = (_LOWER >= ord("a")) & (_LOWER <= ord("z")) | (_OCTETS >= 128)
_DIGIT = (_OCTETS >= ord("0")) & (_OCTETS <= ord("9"))
_KIND = np.select([_CAPITAL, _SMALL, _DIGIT], [np.uint64(2), np.uint64(1), np.uint64(3)], _OCTETS + np.uint64(4))
_SPACE = np.isin(_OCTETS, list(b" \t\n\v\f\r"))


# --- terms ----------------------------------------------------------------------------------------------------------


def _hashed(sequences: np.ndarray) -> np.ndarray:
    return ((sequences * _MIX) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _words(octets: np.ndarray) -> np.ndarray:
    """A number for each word, in order, the same for equal words."""
    space = _SPACE[octets]
    first = ~space & np.append(True, space[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return np.empty(0, np.uint64)
    place = np.arange(len(octets)) - start[np.maximum(np.cumsum(first) - 1, 0)]
    value = np.where(space, np.uint64(0), (_LOWER[octets] + np.uint64(7)) * _POWERS[np.minimum(place, 4095)])
    return np.add.reduceat(value, start)


def term_counts(text: bytes) -> np.ndarray:
    """How often each hashed term is in the text, and behind them how many words repeat another, as shares of all words.

    Long texts are read to their end in stretches; no term reaches from one stretch into the next.
    """
    counts = np.zeros(TERMS)
    words = 0
    for at in range(0, len(text), STRETCH):
        octets = np.frombuffer(text, np.uint8, min(STRETCH, len(text) - at), at)
        low, kinds = _LOWER[octets], _KIND[octets]
        runs = kinds[np.append(True, kinds[1:] != kinds[:-1])]
        orders = runs[:-3] | runs[1:-2] << np.uint64(10) | runs[2:-1] << np.uint64(20) | runs[3:] << np.uint64(30)
        triples = low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)
        found = np.concatenate([_hashed(triples), _hashed(orders + np.uint64(1 << 50))])
        counts[:HASHED] += np.bincount(found, minlength=HASHED)
        word = _words(octets)
        words += len(word)
        counts[HASHED] += np.count_nonzero(word[1:] == word[:-1])
        counts[HASHED + 1] += len(word) - len(np.unique(word))
        counts[HASHED + 2] += sum(np.count_nonzero(word[d:] == word[:-d]) for d in range(2, REACH + 1) if len(word) > d)
    counts[HASHED:] /= max(words, 1)
    return counts


def weighted(texts: Sequence[bytes], rarity: np.ndarray) -> np.ndarray:
    """A row of weights for each text: hashed terms of unit length, and the shares of repeats."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        counts = term_counts(text)
        there = np.flatnonzero(counts[:HASHED])
        weight = (1 + np.log(counts[there])) * rarity[there]
        out[i, there] = weight / (np.sqrt((weight**2).sum()) or 1)
        out[i, HASHED:] = counts[HASHED:] * REPEAT_WEIGHTS
    return out


def rarities(docs: DataFrame) -> np.ndarray:
    """The logarithm of all documents by those that have a hashed term, counted over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen, every = np.zeros(HASHED, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += term_counts(text)[:HASHED] > 0
                every += 1
        terms = np.append(np.flatnonzero(seen), HASHED)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.append(seen, every)[terms])], ["term", "n"])

    octets = docs.select(text_or_empty().cast("binary").alias("text"))
    rows = octets.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(HASHED + 1)
    for r in rows:
        n[r["term"]] = r["n"]
    return np.log((1 + n[HASHED]) / (1 + n[:HASHED]))


# --- the space ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """What scoring needs: of fixed size but for the labelled vectors, which ``LABELLED`` bounds."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, texts: Sequence[bytes]) -> np.ndarray:
        """Unit vectors of texts; zero for a text that has nothing in common with the labelled ones."""
        found = weighted(texts, self.rarity) @ self.axes
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def votes(self, texts: Sequence[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The weighted share of label 1 among each text's nearest labelled documents, those as near as the last included."""
        usual = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), usual)
        if not len(self.labels):
            return out
        last = max(0, len(self.labels) - neighbours)
        for at in range(0, len(texts), BLOCK):
            cosines = np.round(self.place(texts[at : at + BLOCK]) @ self.vectors.T, 5)
            nearest = cosines >= np.partition(cosines, last, axis=1)[:, last : last + 1]
            row, column = np.nonzero(nearest)
            weight = np.maximum(cosines[row, column], 0).astype(float) ** POWER
            total = np.bincount(row, weight, minlength=len(cosines))
            for_one = np.bincount(row, weight * self.labels[column], minlength=len(cosines))
            known = total > 0
            out[at : at + len(cosines)][known] = for_one[known] / total[known]
        return np.round(np.clip(out, 0, 1), 6)


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, expected: int = LABELLED) -> DataFrame:
    """``octets`` and ``quality`` (0 or 1) of labelled documents outside one fold, one row per id, ``expected`` of them.

    Labels without an id or a value are left out, of several labels for one id the highest counts, of several texts the
    least. Which ids are drawn depends on a hash of the id alone; they are few by this bound and sent to every task, so
    that texts of others are not shuffled.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("quality"))
    )
    share = min(1.0, expected / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("octets")).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("octets").alias("octets")).select("octets", "quality")


def _sent(df: DataFrame, value: object) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(value)


def _product(sample: DataFrame, rarity: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The sample's matrix of weights, transposed, times itself, times ``axes``: each task adds up its documents' part."""
    sent = _sent(sample, (rarity, axes))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros((TERMS, axes_shape))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), BLOCK):
                x = weighted(texts[at : at + BLOCK], sent.value[0])
                total += x.T @ (x @ sent.value[1])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    axes_shape = axes.shape[1]
    out = np.zeros((TERMS, axes_shape))
    # a few tasks at a time: the sample is bounded, and so are the parts
    for r in sample.select("octets").coalesce(16).mapInArrow(add, "part binary").toLocalIterator():
        out += np.frombuffer(r["part"]).reshape(TERMS, axes_shape)
    return out


def leading_axes(sample: DataFrame, rarity: np.ndarray, axes: int = AXES, rounds: int = ROUNDS) -> np.ndarray:
    """The axes along which the sample's terms vary most, by subspace iteration from a fixed start."""
    found = np.random.default_rng(0).standard_normal((TERMS, axes)).astype(np.float32)
    for _ in range(rounds):
        found = np.linalg.qr(_product(sample, rarity, found))[0].astype(np.float32)
    return found


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, expected: int = LABELLED) -> Model:
    """A model of the labelled documents outside one fold, and of how rare terms are in all documents.

    Neither ids nor columns other than the text enter it. Without labels every score is a half.
    """
    sample = written(labelled_sample(docs, labels, folds, fold, expected), "labelled")
    rarity = rarities(docs)
    axes = leading_axes(sample, rarity)
    placing = _sent(sample, Model(rarity, axes, np.empty((0, axes.shape[1]), np.float32), np.empty(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = [v.tobytes() for at in range(0, len(texts), BLOCK) for v in placing.value.place(texts[at : at + BLOCK])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["vector", "quality"])

    placed = sample.select("octets", "quality").mapInArrow(place, "vector binary, quality int").collect()
    vectors = np.frombuffer(b"".join(r["vector"] for r in placed), np.float32).reshape(-1, axes.shape[1])
    return Model(rarity, axes, vectors, np.array([r["quality"] for r in placed], float))


def with_quality(docs: DataFrame, model: Model, keep: Sequence[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the quality of the whole ``text`` between 0 and 1 as column ``name``.

    A column of that name is replaced. A null or empty text is near to no labelled one and gets the share of label 1.
    Rows, their number and other columns stay as they are; an empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            scores = sent.value.votes(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*batch.schema.names[:-1], name])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().cast("binary").alias("~octets"))
    return chosen.mapInArrow(run, f"{fields}`{name}` double")
