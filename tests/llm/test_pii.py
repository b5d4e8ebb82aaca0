"""Patterns against plain regular expressions, and what the field adds."""

import re
from itertools import pairwise

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import pii


def plain_luhn(digits):
    doubled = [n * (1 + i % 2) for i, n in enumerate(map(int, reversed(digits)))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def plain_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m)) <= 19 and plain_luhn(digits(m)):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m)) <= 15:
            out.append(("phone", *m.span()))
    return out


PARTS = st.sampled_from(["a", "B.", "@", "@x", ".", "1", "0", "255", "256", "12.3", "4111", " ", "-", "+", "+4", "(", ")", "é", "\n", "4111111111111111"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_patterns_match_plain_expressions(text):
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == plain_spans(text)


def test_patterns_are_linear_on_long_runs():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1.1." * 50_000, "+1" * 50_000, "." * 200_000):
        pii.base_spans(text)


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(3)
    unary, pair = rng.normal(size=(3, 5)), rng.normal(size=(2, 5, 5))
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + pair[0][:, :, None] + pair[1][None, :, :])
    joint /= joint.sum()
    got = pii.marginals(unary, np.array([0, 1]), np.array([1, 2]), pair)
    for i, axes in enumerate([(1, 2), (0, 2), (0, 1)]):
        np.testing.assert_allclose(got[i], joint.sum(axis=axes), atol=1e-2)


def test_field_labels_repeats_without_the_pattern(spark, documents):
    """A number known with its country code is found again without it; lone numbers in other texts stay."""
    both = "call +1 (743) 555-38{0:02d} now, or again (743) 555-38{0:02d} at night"
    rows = [(i, both.format(i)) for i in range(60)] + [(100 + i, f"part number (612) 555-10{i:02d} is in stock") for i in range(20)]
    found = {r.doc_id: r["~spans"] for r in pii.find_personal_data(documents(rows)).collect()}
    for i in range(60):
        assert [s.kind for s in found[i]] == [3, 3]
    assert all(found[100 + i] == [] for i in range(20))


def test_redaction_replaces_overlapping_spans_once(spark, documents):
    text = "mail a@b.de or +49 170 1234567, server 10.0.0.1"
    got = {r.doc_id: r for r in pii.redact(documents([(1, text), (2, "nothing here"), (3, None), (4, "")])).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE], server [IP]"
    assert got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[3].n_chars, got[4].text) == ("nothing here", None, None, "")
    assert got[1].score == "x"
    spans = [r.span for r in pii.redact(documents([(1, "4111111111111111 x 4111 1111 1111 1111")])).selectExpr("text AS span").collect()]
    assert spans == ["[CARD] x [CARD]"]
    assert all(a <= b for a, b in pairwise([0, 1]))
