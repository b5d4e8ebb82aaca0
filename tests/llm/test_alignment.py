"""Alignment of two tokenizers against plain set operations over byte offsets."""

import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import alignment, queries, tokens
from tests.llm.test_operators import ODD


def byte_values():
    """What the characters of a byte-level vocabulary stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.values = byte_values()

    def tokens(self, text):
        whole = (" " + text).encode()
        a = [(i, bytes(self.values[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        same = text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        return (a, b) if same else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
        common = set(ends[0]) & set(ends[1])
        sides = []
        for side, own in zip((a, b), ends, strict=True):
            parts = [[]]
            for (i, _), end in zip(side, own, strict=True):
                parts[-1].append(i)
                if end in common:
                    parts.append([])
            sides.append(parts[:-1])
        return [list(g) for g in zip(*sides, strict=True)]


PLAIN = Plain()


@pytest.fixture(scope="module")
def plain():
    return PLAIN


def expected(plain, rows):
    groups = [(doc, plain.groups(text or "")) for doc, text in rows]
    counts = collections.Counter((a[-1], b[-1]) for _, gs in groups for a, b in gs)
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc, gs in groups:
        links = [(a[-1], b[-1]) for a, b in gs]
        listed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        out.append((
            doc, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links),
            sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(listed.encode()).hexdigest() if gs else "",
        ))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = ["<|endoftext|> and <s> </s> <unk> <0x41>", "▁ under", "a  b   c\n\n\td ", "   ", "漢字🙂é́", "\x00\x01", "x" * 3000 + " y", "=" * 500, "one\r\ntwo three", "ﬁ ½ Å"]


def test_query_matches_plain_sets(spark, sf, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_alignment"](spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(expected(plain, rows))


@pytest.mark.parametrize("links", [1 << 21, 5])
def test_odd_texts_in_blocks_of_any_size(spark, documents, plain, monkeypatch, links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    rows = [*ODD, *enumerate(TEXTS, 100), *enumerate(TEXTS, 100)]
    got = alignment.link_counts(documents(rows)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(plain, rows)))
    assert alignment.link_counts(documents(ODD).limit(0)).collect() == []


def test_groups_are_given_back(spark, documents, plain):
    rows = [*ODD, *enumerate(TEXTS, 100)]
    got = alignment.align(documents(rows)).collect()
    assert len(got) == len(rows) and got[0].score == "x"
    for r in got:
        assert [[g.a, g.b] for g in r.groups] == plain.groups(r.text or "")
    assert alignment.align(documents(ODD).limit(0)).collect() == []


@pytest.mark.parametrize("probes", [1, 3, 12])
@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 200), st.integers(1, 5))
def test_shared_cuts_are_the_common_ends(probes, seed, size, texts):
    rng, known = random.Random(seed), alignment.PROBES
    sides, bounds, want = ([], []), ([0], [0]), []
    for i in range(texts):
        own = [sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))}) for _ in range(2)]
        if rng.random() < 0.2:
            own = [[], []]
        want += sorted({i * size + x for x in own[0]} & {i * size + x for x in own[1]})
        for side, bound, ends in zip(sides, bounds, own, strict=True):
            side += [i * size + x for x in ends]
            bound.append(len(side))
    a, b = (np.array(x, np.int64) for x in sides)
    alignment.PROBES = probes
    try:
        a_cuts, b_cuts = alignment.shared_cuts(a, b, *map(np.array, bounds))
    finally:
        alignment.PROBES = known
    assert a[a_cuts - 1].tolist() == b[b_cuts - 1].tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é漢🙂\u0301\u00a0\u2581\u3000\x1c\x85\n\t  .'s9<|>"), max_size=30) | st.text(max_size=20))
def test_any_text_has_the_groups_of_plain_sets(text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    aligner = alignment.aligner(tokens.vocabulary_path(), alignment.pieces_path())
    before, got, after = aligner.align(["one two", text, "three"])
    assert list(map(list, got.groups())) == PLAIN.groups(text)
    assert list(map(list, after.groups())) == PLAIN.groups("three")
