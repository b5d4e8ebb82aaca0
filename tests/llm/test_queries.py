"""Queries against their SQL, and the contracts of those that SQL can't express against plain Python."""

import collections
import glob
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import packing, queries
from recordloom.llm.tables import written


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_has_the_rows_of_its_sql(name, spark, sf, db):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want, key=key)


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return dict(zip(texts, (e.ids for e in tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))


def test_packing_holds_every_id_once(spark, sf, texts):
    ids = {d: [*i, 1] for d, i in reference_ids(texts).items()}
    cut, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows(spark, sf, "op1_packing"):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), len(ids[r.doc_id])) == (r.length, r.doc_tokens)
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        cut[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, whole in ids.items():
        assert sum(n for _, n in cut[d]) == len(whole)
        assert [s for s, _ in sorted(cut[d])] == list(range(0, len(whole), 2048))
    assert sorted(sequences) == list(range(len(sequences)))
    used = []
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        used.append(sum(n for _, n in pieces))
    assert max(used) <= 2048
    assert sum(used) > 0.98 * 2048 * len(used)


def test_token_counts_match_a_plain_count(spark, sf, texts):
    lengths = np.array([len(i) for i in reference_ids(texts).values()])
    got = rows(spark, sf, "op7_token_counts")
    assert {r.length for r in got} == set(lengths.tolist())
    for r in got:
        assert r.documents == (lengths == r.length).sum()
        assert (r.documents_from, r.tokens_from) == ((lengths >= r.length).sum(), lengths[lengths >= r.length].sum())
        assert r.truncated_total == np.minimum(lengths, r.length).sum()
        assert r.share_within == pytest.approx((lengths <= r.length).mean())


def test_simhash_matches_all_pairs(spark, sf, texts):
    def fingerprint(text):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = {r.doc_id: r for r in rows(spark, sf, "op9_simhash")}
    ids = sorted(texts)
    assert all(got[d].fingerprint == f"{fingerprint(texts[d]):016x}" for d in ids[:60])
    marks = np.array([int(got[d].fingerprint, 16) for d in ids], np.uint64)
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2
    label = np.arange(len(ids))
    while (new := np.where(near, label, len(ids)).min(axis=1)).tolist() != label.tolist():
        label = new
    assert all(got[d].component_id == ids[label[i]] for i, d in enumerate(ids))


def test_language_model_base_score(spark, sf, texts):
    counts = collections.Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update([*t.encode().lower().split(), "end"])
    total, distinct = sum(counts.values()), len(counts)
    got = rows(spark, sf, "op5_language_model")
    assert len(got) == len(texts)
    for r in got:
        tokens = [*texts[r.doc_id].encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.score < 0
    # held-out texts take fewer bits than the four or so of a good byte-wise code
    bits = -sum(r.score for r in got if r.held_out) / math.log10(2)
    assert bits < 4 * sum(len(texts[r.doc_id].encode()) for r in got if r.held_out)


def test_weighted_samples_estimate_generalised_jaccard(spark, sf, texts):
    def likeness(a, b):
        a, b = (collections.Counter(t.encode().lower().split()) for t in (a, b))
        every = sum((a | b).values())
        return sum((a & b).values()) / every if every else 1.0

    ids = sorted(texts)
    by_id = {r.doc_id: r for r in rows(spark, sf, "op8_weighted_sampling")}
    assert len(by_id) == len(ids)
    off = []
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        r = by_id[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        off += [r.near_edited - likeness(text, edited), r.near_next - likeness(text, after)]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.09
    prints = collections.defaultdict(set)
    for d in ids:
        prints[texts[d]].add(by_id[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_toxicity_on_held_out_documents(spark, sf):
    """On ten times the tables of the other tests: ten toxic documents, as those have, are too few to learn from."""
    larger = os.path.join(os.path.dirname(sf), "sf0.01")
    toxic = dict(duckdb.execute(f"SELECT doc_id, toxic FROM '{larger}/labels.parquet'").fetchall())
    got = rows(spark, larger, "op2_toxicity")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    known = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    bad, good = ([s for s, y in known if y == k] for k in (1, 0))
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.75


def test_decontamination_finds_every_exact_passage(spark, sf, db, texts):
    items = dict(db.execute("SELECT item_id, text FROM benchmark").fetchall())
    got = rows(spark, sf, "op4_decontamination")
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if b.lower() in t.lower()}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in got}
    for r in got:
        if r.edits == 0:
            assert texts[r.doc_id][r.start : r.end].lower() == items[r.item_id].lower()


def test_personal_data_matches_the_plain_patterns(spark, sf, texts):
    from tests.llm.test_pii import plain_spans

    for r in rows(spark, sf, "op10_pii"):
        spans = plain_spans(texts[r.doc_id])
        kinds = collections.Counter(k for k, _, _ in spans)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def test_pipeline_takes_odd_rows_and_empty_tables(spark, sf, documents, tmp_path):
    from tests.llm.test_operators import ODD

    for name, rows in (("odd", ODD), ("none", [])):
        folder = tmp_path / name
        documents(rows).write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{other}.parquet").limit(1000 if rows else 0).write.parquet(f"{folder}/{other}.parquet")
        kept = {r.doc_id for r in corpus_pipeline.run(spark, str(folder)).select("doc_id").distinct().collect()}
        # copies and texts without words are one document each
        assert kept == ({1, 3, 6, 7, None} if rows else set())


def test_pipeline_stages_act_on_what_is_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf), name)
        assert after.schema == docs.schema
        kept.append(after.count())
        docs = after
    toxic, near, leaks, private = (b - a for b, a in zip(kept, kept[1:], strict=False))
    assert toxic >= 0 and near > 0 and leaks > 0 and private == 0
    assert docs.where(F.col("text").rlike(r"\[(EMAIL|IP|CARD|PHONE)\]")).count() > 0
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    whole = packing.pieces(docs).groupBy("doc_id").count().count()
    assert whole == docs.count()
