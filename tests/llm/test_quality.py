"""Quality votes against plain cosines, and the accuracy on documents whose labels were not seen."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from recordloom.llm import quality, queries
from tests.llm.test_operators import ODD


@pytest.fixture(scope="module")
def larger(sf):
    return os.path.join(os.path.dirname(sf), "sf0.01")


def test_held_out_documents_are_told_apart(spark, larger):
    labels = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{larger}/labels.parquet'").fetchall())
    got = queries.QUERIES["op11_quality"](spark, larger).collect()
    assert len(got) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert len(right) > 100 and np.mean(right) > 0.97


def labels_for(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")


def test_odd_rows_are_all_judged(spark, documents):
    model = quality.train(documents(ODD), labels_for(spark))
    got = quality.with_quality(documents(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert "lang" in got[0] and quality.with_quality(documents(ODD).limit(0), model).collect() == []
    same = {r.score for r in got if r.text == "same text"}
    assert len(same) == 1
    usual = model.labels.mean()
    assert all(r.score == pytest.approx(usual, abs=1e-6) for r in got if not r.text)


def test_no_labels_and_no_documents(spark, documents):
    model = quality.train(documents(ODD), labels_for(spark).limit(0))
    assert {r.score for r in quality.with_quality(documents(ODD), model, ["doc_id"]).collect()} == {0.5}
    empty = quality.train(documents(ODD).limit(0), labels_for(spark))
    assert {r.score for r in quality.with_quality(documents(ODD), empty, ["doc_id"]).collect()} == {0.5}


def test_votes_are_those_of_the_nearest(spark, sf):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta!", "GAMMA", "| 12"], 30)).encode() for _ in range(600)]
    rarity = np.ones(quality.HASHED)
    axes = np.linalg.qr(rng.standard_normal((quality.TERMS, 8)))[0].astype(np.float32)
    labelled, others = texts[:100], texts[100:]
    blank = quality.Model(rarity, axes, np.empty((0, 8), np.float32), np.empty(0))
    model = quality.Model(rarity, axes, blank.place(labelled), rng.integers(0, 2, 100).astype(float))
    got = model.votes(others)
    for text, score in zip(others[::37], got[::37], strict=True):
        vector = quality.weighted([text], rarity)[0] @ axes
        cosines = np.round([vector @ v / np.linalg.norm(vector) for v in model.vectors], 5)
        near = np.flatnonzero(cosines >= np.sort(cosines)[-quality.NEIGHBOURS])
        weight = np.maximum(cosines[near], 0) ** quality.POWER
        assert score == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-3)


def test_terms_cover_long_texts(monkeypatch):
    text = b"one two two THREE|4 " * 50
    whole = quality.term_counts(text)
    monkeypatch.setattr(quality, "STRETCH", 100)
    parts = quality.term_counts(text)
    assert parts[: quality.HASHED].sum() >= whole[: quality.HASHED].sum() * 0.9
    assert whole[quality.HASHED] == parts[quality.HASHED] == 0.25
    assert quality.term_counts(b"").sum() == 0


def test_axes_span_what_varies_most(spark, documents):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["ab", "cd!", "EF"], 20))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    sample = quality.labelled_sample(documents(rows), labels)
    rarity = np.ones(quality.HASHED)
    kept = [r.octets for r in sample.collect()]
    x = quality.weighted([bytes(t) for t in kept], rarity)
    axes = quality.leading_axes(sample, rarity, axes=4, rounds=8)
    best = np.linalg.svd(x, full_matrices=False)[1][:4]
    assert np.linalg.norm(x @ axes) ** 2 == pytest.approx((best**2).sum(), rel=0.01)
