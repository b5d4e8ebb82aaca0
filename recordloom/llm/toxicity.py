"""Toxicity by a lexicon trie that is intersected with Levenshtein automata, and by the context of its hits.

The lexicon is learnt from labelled documents: words, and stems (beginnings of words), that toxic documents have far
more often than others. A word of a text is turned into its Levenshtein automaton, which walks the trie of the words:
branches that no spelling within the edit bound can reach are cut off. Stems match as they are. Every hit carries its
term's log odds; hits between quotation marks or next to a word of reporting are summed apart from the others, and a
window of a few words looks for the densest place. A logistic regression turns these sums into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tables import held_out, text_or_empty, written
from recordloom.llm.worker import held

#: The expected number of labelled documents that the lexicon and the regression are fitted on, drawn by a hash of the id.
LABELLED = 20_000
TERMS = 400
CANDIDATES = 50_000
LEAST_DOCUMENTS = 5
LEAST_LOG_ODDS = 2.0
STEM_LENGTHS = range(4, 9)
FUZZY_LENGTH = 5
FUZZY_SHARE = 0.7
WINDOW = 12
QUOTE_REACH = 6
CACHED_WORDS = 200_000

EDGES = " \t\n\r\v\f.,;:!?()[]{}<>|/\\\"'`“”„«»‘’…*#$%&+=~^_-"
QUOTES = tuple("\"“”„«»")
#: Words that announce a quotation: fixed values.
REPORTING = frozenset("said says wrote writes quoted quote called calls term word dit dites écrit sagte schrieb zitat wort dijo escribió palabra".split())


# --- the trie and the automaton -------------------------------------------------------------------------------------


@dataclass
class Node:
    weight: float = 0.0
    below: dict[str, Node] = field(default_factory=dict)


def build_trie(terms: dict[str, float]) -> Node:
    root = Node()
    for term, weight in terms.items():
        node = root
        for c in term:
            node = node.below.setdefault(c, Node())
        node.weight = weight
    return root


def near_terms(root: Node, word: str) -> tuple[float, float]:
    """The greatest weight of terms equal to ``word``, and of terms of ``FUZZY_LENGTH`` or more at one edit from it.

    The automaton's states are bit sets of positions in the word, one for no edit and one for one edit. A step along a
    trie edge moves on where the word has that character; an edit skips a character of the term, of the word, or of both.
    """
    size = len(word)
    where: dict[str, int] = {}
    for i, c in enumerate(word):
        where[c] = where.get(c, 0) | 1 << i
    accept, valid = 1 << size, (1 << (size + 1)) - 1
    exact = fuzzy = 0.0
    stack = [(root, 1, 2, 0)]
    while stack:
        node, none, one, depth = stack.pop()
        if node.weight:
            if none & accept:
                exact = max(exact, node.weight)
            elif one & accept and depth >= FUZZY_LENGTH:
                fuzzy = max(fuzzy, node.weight)
        for c, child in node.below.items():
            at = where.get(c, 0)
            none_next = (none & at) << 1
            one_next = ((one & at) << 1 | none | none << 1 | none_next << 1) & valid
            if none_next or one_next:
                stack.append((child, none_next, one_next, depth + 1))
    return exact, fuzzy


@dataclass(frozen=True)
class Lexicon:
    words: tuple[tuple[str, float], ...]
    stems: tuple[tuple[str, float], ...]


class Matcher(dict):
    """(weight, whether misspelt, term number) of a word as it stands in a text, or None; words are the keys."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        words = dict(lexicon.words)
        self.trie, self.stems = build_trie(words), dict(lexicon.stems)
        self.stem_lengths = sorted({len(s) for s in self.stems})
        # one edit leaves either the first or the second half of a term as it is
        long = [w for w in words if len(w) >= FUZZY_LENGTH]
        self.halves = {(len(w) // 2, w[: len(w) // 2]) for w in long} | {(-(len(w) - len(w) // 2), w[len(w) // 2 :]) for w in long}
        self.starts = sorted({n for n, _ in self.halves if n > 0})
        self.ends = sorted({-n for n, _ in self.halves if n < 0})
        self.words = words
        self.longest = max((len(w) for w in words), default=0) + 1

    def match(self, word: str) -> tuple[float, bool] | None:
        best, misspelt = self.words.get(word, 0.0), False
        for n in self.stem_lengths:
            best = max(best, self.stems.get(word[:n], 0.0))
        if not best and FUZZY_LENGTH - 1 <= len(word) <= self.longest and self._may_be_near(word):
            _, near = near_terms(self.trie, word)
            best, misspelt = near * FUZZY_SHARE, near > 0
        return (best, misspelt) if best else None

    def _may_be_near(self, word: str) -> bool:
        halves = self.halves
        return any((n, word[:n]) in halves for n in self.starts) or any((-n, word[-n:]) in halves for n in self.ends)

    def __missing__(self, raw: str) -> tuple[float, bool] | None:
        found = self.match(raw.strip(EDGES))
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(raw) < 64:
            self[raw] = found
        return found


def matcher(lexicon: Lexicon) -> Matcher:
    """The matcher that this Python worker holds."""
    return held((Matcher, lexicon), lambda: Matcher(lexicon))


# --- features -------------------------------------------------------------------------------------------------------


def _quoted(words: Sequence[str], at: int) -> bool:
    """Whether the word stands between quotation marks, or behind a word of reporting, within a few words."""
    before, after = words[max(0, at - QUOTE_REACH) : at + 1], words[at : at + QUOTE_REACH + 1]
    opened = any(w.startswith(QUOTES) for w in before)
    closed = any(w.rstrip(".,;:!?)").endswith(QUOTES) for w in after)
    return (opened and closed) or any(w.strip(EDGES) in REPORTING for w in before[:-1])


FEATURES = 6


def features(text: str, match: Matcher) -> list[float]:
    """Sums of log odds: spelt, misspelt, quoted; the densest window; all against length; number of distinct terms."""
    words = text.lower().split()
    hits = [(i, h) for i, h in enumerate(map(match.__getitem__, words)) if h]
    if not hits:
        return [0.0] * FEATURES
    spelt = misspelt = quoted = densest = 0.0
    window: list[tuple[int, float]] = []
    for i, (weight, wrong) in hits:
        if _quoted(words, i):
            quoted += weight
            continue
        if wrong:
            misspelt += weight
        else:
            spelt += weight
        window = [(j, w) for j, w in window if i - j < WINDOW] + [(i, weight)]
        densest = max(densest, sum(w for _, w in window))
    distinct = len({words[i].strip(EDGES) for i, _ in hits})
    return [
        float(np.log1p(spelt)),
        float(np.log1p(misspelt)),
        float(np.log1p(quoted)),
        float(np.log1p(densest)),
        (spelt + misspelt) / float(np.sqrt(len(words) + 10)),
        float(np.log1p(distinct)),
    ]


# --- learning -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]

    def score(self, rows: Sequence[Sequence[float]]) -> np.ndarray:
        x = np.array(rows, float).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, expected: int = LABELLED) -> DataFrame:
    """``text`` and ``toxic`` (0 or 1) of labelled documents outside the first of ``folds`` folds, ``expected`` of them.

    Labels without an id or a value are left out; of several labels for one id the highest counts. Which documents are
    drawn depends on a hash of the id alone. Their ids are few by this bound and are sent to every task, so that texts
    are not shuffled.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), folds))
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    share = min(1.0, expected / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "toxic")


def _terms(text: str) -> set[str]:
    """A document's distinct words, and their beginnings marked by a star."""
    words = {w.strip(EDGES) for w in set(text.lower().split())}
    return {w for w in words if 3 < len(w) < 40} | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}


def _document_counts(sample: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """``term`` and the number of documents that have it; within a task, equal terms are added up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = _terms(text)
                seen.update(terms if wanted is None else terms & wanted)
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    return sample.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> Lexicon:
    """The terms with the clearest difference between toxic and other documents, with their log odds."""
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    often = (
        _document_counts(sample.where("toxic = 1"))
        .where(F.col("n") >= LEAST_DOCUMENTS)
        .orderBy(F.desc("n"), "term")
        .limit(CANDIDATES)
        .collect()
    )
    within = {r["term"]: r["n"] for r in often}
    beside = {r["term"]: r["n"] for r in _document_counts(sample.where("toxic = 0"), frozenset(within)).collect()}
    found = []
    for term, n in within.items():
        m = beside.get(term, 0)
        odds = np.log((n + 0.5) / (toxic - n + 0.5)) - np.log((m + 0.5) / (other - m + 0.5))
        if odds >= LEAST_LOG_ODDS:
            found.append((n * odds, term, float(odds)))
    best = [(term, odds) for _, term, odds in sorted(found, key=lambda f: (-f[0], f[1]))[:terms]]
    return Lexicon(
        tuple(sorted((t, o) for t, o in best if not t.endswith("*"))),
        tuple(sorted((t[:-1], o) for t, o in best if t.endswith("*"))),
    )


def labelled_features(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``features`` and ``toxic`` of each document of a labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(lexicon)
        for batch in batches:
            rows = [features(t, match) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["features", "toxic"])

    return sample.select("text", "toxic").mapInArrow(run, "features array<double>, toxic int")


def learn_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small L2 penalty; without labels, the score is always a half."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 1e-2)
    for _ in range(25 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, expected: int = LABELLED) -> Model:
    """A model from the labelled documents outside the first fold; neither ids nor other columns enter it."""
    sample = written(labelled_sample(docs, labels, folds, expected), "labelled")
    lexicon = learn_lexicon(sample)
    rows = labelled_features(sample, lexicon).collect()
    x = np.array([r["features"] for r in rows], float).reshape(-1, FEATURES)
    return Model(lexicon, learn_weights(x, np.array([r["toxic"] for r in rows], float)))


def with_toxicity(docs: DataFrame, model: Model, keep: Sequence[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of the whole ``text`` between 0 and 1.

    A null or empty text has no hits. Equal texts have equal scores; rows, their order and other columns are not changed,
    but a column called ``name`` is replaced. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(model.lexicon)
        for batch in batches:
            rows = [features(t, match) for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(rows))], [*batch.schema.names[:-1], name])

    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("~text"))
    return chosen.mapInArrow(run, f"{fields}`{name}` double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold`` or whose text has no hit, all columns as they are.

    So null and empty texts stay, whatever the share of toxic labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(model.lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            rows = [features(t or "", match) for t in texts]
            clean = [s < threshold or not any(r) for s, r in zip(model.score(rows), rows, strict=True)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
