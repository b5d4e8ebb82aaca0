"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans. The field's nodes are a document's number groups and words with an at sign; neighbours
are linked as a chain, and nodes of the same form (equal last digits, equal address) share a potential however far apart
they are. Loopy message passing then carries a label to repeats that no pattern matches, such as a telephone number
written again without its country code. A node that gets a label with enough certainty becomes a span besides the base
ones, which always stay.

The field is trained here, piecewise: base spans are the labels, and nodes without one count little, since they are
unlabelled rather than known to be harmless. Unary weights are a logistic regression on counts of feature combinations
(a few thousand at most), pair potentials are smoothed associations of labels on both kinds of link. All counts are over
all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tables import text_or_empty, written
from recordloom.llm.worker import let_go

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "none")
NONE = len(KINDS)

# the patterns' fixed character classes
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a look-behind and possessive repeats: the same matches, in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++")
HOST = re.compile(r"[A-Za-z0-9.-]++")
NODE_DIGITS = 7
FORM_DIGITS = 7

UNLABELLED_WEIGHT = 0.02
#: Pairs with equal labels that skip links are taken to have had before any is counted.
SAME_FORM = 100.0
PENALTY = 0.003
CERTAIN = 0.9
ROUNDS = 10
DAMPING = 0.5

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _addresses(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, at sign, end) of each at sign with a local part; end is 0 if no domain with a dot follows."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if start < at:
            yield start, at, found.end() if found else 0
        after = found.end() if found else at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns' matches, by kind, then start. Leftmost first, without overlap within a kind."""
    spans = [(0, start, end) for start, _, end in _addresses(text) if end]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                spans.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() <= 37 else ""
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((3, *m.span()))
    return spans


def _nodes(text: str, base: Sequence[Span]) -> list[dict]:
    """The field's nodes in text order: span, form, feature combination, and the label that base spans give."""
    found = []
    for start, at, end in _addresses(text):
        host = HOST.match(text, at + 1)
        if host:
            stop = max(end, host.end())
            found.append((start, stop, "@" + text[start:stop].rstrip(".-").lower(), f"@,{'.' in host.group()[1:-1]}"))
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if len(digits) >= NODE_DIGITS:
                seen = m.group()
                dots = min(seen.count("."), 4)
                marks = "".join(c for c in "+( -" if c in seen)
                card = f"luhn{_luhn(digits)}" if 13 <= len(digits) <= 19 else "short" if len(digits) < 13 else "long"
                found.append((*m.span(), digits[-FORM_DIGITS:], f"#,n{min(len(digits), 20)},d{dots},{card},m{marks}"))
    found.sort()
    out, at = [], 0
    by_start = sorted((start, end, kind) for kind, start, end in base)
    for start, end, form, features in found:
        while at < len(by_start) and by_start[at][1] <= start:
            at += 1
        over = [kind for s, e, kind in by_start[at : at + 4] if s < end and e > start]
        out.append({"start": start, "end": end, "label": min(over, default=NONE), "form": form, "features": features})
    return out


def _links(nodes: Sequence[dict]) -> list[dict]:
    """Chain links between neighbours; skip links from each node to the last and to the first one of its form."""
    links = [{"skip": False, "a": i - 1, "b": i} for i in range(1, len(nodes))]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for i, node in enumerate(nodes):
        form = node["form"]
        if form in last:
            links += [{"skip": True, "a": a, "b": i} for a in {first[form], last[form]}]
        first.setdefault(form, i)
        last[form] = i
    return links


SPANS = "array<struct<kind:int,start:int,end:int>>"
NODES = "array<struct<start:int,end:int,label:int,form:string,features:string>>"
LINKS = "array<struct<skip:boolean,a:int,b:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_NODES = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("form", pa.string()), ("features", pa.string())])
)
_LINKS = pa.list_(pa.struct([("skip", pa.bool_()), ("a", pa.int32()), ("b", pa.int32())]))


def scan(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` with ``~base``, ``~nodes`` and ``~links`` of ``text``; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            base, nodes, links = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                spans = base_spans(text)
                found = _nodes(text, spans)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                nodes.append(found)
                links.append(_links(found))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(base, _SPANS), pa.array(nodes, _NODES), pa.array(links, _LINKS)],
                [*batch.schema.names[:-1], "~base", "~nodes", "~links"],
            )

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("~text"))
    return chosen.mapInArrow(run, f"{fields}`~base` {SPANS}, `~nodes` {NODES}, `~links` {LINKS}")


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Log potentials: unary by feature (a missing feature counts nothing), and one matrix per kind of link."""

    unary: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, features: str) -> np.ndarray:
        return sum((self.unary[f] for f in ("bias", *features.split(",")) if f in self.unary), np.zeros(len(LABELS)))


def _association(counts: np.ndarray) -> np.ndarray:
    """Smoothed log of how much likelier two labels are linked than by chance; symmetric."""
    counts = counts + counts.T + 0.5
    share = counts / counts.sum()
    alone = share.sum(axis=0)
    return np.log(share / np.outer(alone, alone))


def _regression(rows: Sequence[tuple[str, int, float]]) -> dict[str, np.ndarray]:
    """Multinomial logistic regression, with an L2 penalty, on weighted feature combinations."""
    if not rows:
        return {}
    names = {"bias": 0}
    for features, _, _ in rows:
        for f in features.split(","):
            names.setdefault(f, len(names))
    x = np.zeros((len(rows), len(names)))
    x[:, 0] = 1
    for i, (features, _, _) in enumerate(rows):
        x[i, [names[f] for f in features.split(",")]] = 1
    y = np.eye(len(LABELS))[[label for _, label, _ in rows]]
    weight = np.array([n for _, _, n in rows])
    weight = weight / weight.sum()
    w = np.zeros((len(names), len(LABELS)))
    velocity = np.zeros_like(w)
    for _ in range(500):
        score = x @ w
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        velocity = 0.9 * velocity - x.T @ ((p - y) * weight[:, None]) - PENALTY * w
        w += velocity
    return {name: w[i] for name, i in names.items()}


def fit(scanned: DataFrame) -> Field:
    """Counts over all of ``scanned`` (a stored table); what reaches the driver is one row per feature combination."""
    node = scanned.select(F.explode("~nodes").alias("n")).groupBy("n.features", "n.label").agg(F.count("*").alias("times"))
    rows = sorted((r["features"], r["label"], r["times"] * (UNLABELLED_WEIGHT if r["label"] == NONE else 1.0)) for r in node.collect())
    end = lambda side: F.element_at("nodes", F.col(f"link.{side}") + 1)["label"].alias(side)
    links = (
        scanned.select(F.col("~nodes").alias("nodes"), F.explode("~links").alias("link"))
        .select("link.skip", end("a"), end("b"))
        .groupBy("skip", "a", "b")
        .agg(F.count("*").alias("times"))
    )
    counts = {True: np.zeros((len(LABELS),) * 2), False: np.zeros((len(LABELS),) * 2)}
    for r in links.collect():
        open_ends = (r["a"] == NONE) + (r["b"] == NONE)
        # where one of two equal forms has a label, the other's is not known to differ
        if not (r["skip"] and open_ends == 1):
            counts[r["skip"]][r["a"], r["b"]] += r["times"] * UNLABELLED_WEIGHT**open_ends
    same = np.eye(len(LABELS)) * SAME_FORM
    return Field(_regression(rows), _association(counts[False]), _association(counts[True] + same))


def marginals(unary: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy sum-product messages; ``pair[i]`` holds the log potentials of link ``a[i]``-``b[i]``."""

    def normal(m: np.ndarray) -> np.ndarray:
        m = m - m.max(axis=1, keepdims=True)
        return m - np.log(np.exp(m).sum(axis=1, keepdims=True))

    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    potential = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    messages = normal(np.zeros((len(source), unary.shape[1])))
    for _ in range(ROUNDS if len(source) else 0):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        out = (belief[source] - messages[back])[:, :, None] + potential
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        messages = normal(DAMPING * messages + (1 - DAMPING) * normal(new))
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return np.exp(normal(belief))


def added_spans(base: Sequence[dict], nodes: Sequence[dict], links: Sequence[dict], field: Field) -> list[Span]:
    """Spans that the field adds: nodes that touch no base span and whose label is certain enough."""
    if not nodes:
        return []
    unary = np.stack([field.potentials(n["features"]) for n in nodes])
    # what the patterns have found is known
    for i, n in enumerate(nodes):
        if n["label"] != NONE:
            unary[i] = np.where(np.arange(len(LABELS)) == n["label"], 0.0, -30.0)
    a, b = (np.array([x[side] for x in links], np.int64) for side in ("a", "b"))
    pair = np.stack([field.skip if x["skip"] else field.chain for x in links]) if links else np.empty((0, len(LABELS), len(LABELS)))
    p = marginals(unary, a, b, pair)
    best = p.argmax(axis=1)
    return [
        (int(best[i]), n["start"], n["end"])
        for i, n in enumerate(nodes)
        if n["label"] == NONE and best[i] != NONE and p[i, best[i]] >= CERTAIN
    ]


def label(scanned: DataFrame, field: Field) -> DataFrame:
    """Adds ``~spans``, base and added ones by kind, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for base, nodes, links in zip(*(columns[c].to_pylist() for c in ("~base", "~nodes", "~links")), strict=True):
                spans = sorted([(s["kind"], s["start"], s["end"]) for s in base] + added_spans(base, nodes, links, field))
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            kept = [n for n in batch.schema.names if n not in ("~nodes", "~links")]
            yield pa.RecordBatch.from_arrays([*[columns[n] for n in kept], pa.array(out, _SPANS)], [*kept, "~spans"])

    kept = [f for f in scanned.schema.fields if f.name not in ("~nodes", "~links")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return scanned.mapInArrow(run, f"{fields}, `~spans` {SPANS}")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_personal_data(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with arrays ``~base`` and ``~spans`` of (kind, start, end), one row per row of ``docs``.

    Offsets are code points of the whole text, ends exclusive, kinds are positions in ``KINDS``. A null or empty text
    has no spans. Rows are judged one by one, so nulls, repeated rows and equal doc_ids are kept as they are; equal
    texts have equal spans. An empty table stays empty.
    """
    scanned = written(scan(docs, keep), "scanned")
    return label(scanned, fit(scanned))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one, of the first kind.

    Where there is a column ``n_chars``, it is counted anew in the rows that change. A null text stays null.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = columns["text"].to_pylist()
            for row, spans in enumerate(columns.pop("~spans").to_pylist()):
                if spans:
                    text, parts, at = texts[row], [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                        at = max(at, s["end"])
                    texts[row] = "".join([*parts, text[at:]])
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    found = find_personal_data(docs, docs.columns).select(*[F.col(f"`{c}`") for c in docs.columns], "~spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    changed = F.size("~spans") > 0
    cleaned = found.withColumn("~changed", changed).mapInArrow(clean, f"{fields}, `~changed` boolean")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("~changed"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.drop("~changed")
