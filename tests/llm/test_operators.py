"""Each operator on hand-made cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import (
    chat,
    components,
    decontaminate,
    language_model,
    lengths,
    packing,
    pii,
    simhash,
    tokens,
    toxicity,
    url_filter,
    weighted_sampling,
)

LONG = "word " * 30_000 + "x" * 20_000
ODD = [(1, None), (2, ""), (None, "some text here"), (None, None), (3, "same text"), (3, "same text"), (4, "same text"), (5, " \t\n"), (6, LONG), (7, "é漢🙂\u2028 \x00 end")]


# --- the same odd table for every operator on documents --------------------------------------------------------------


def labels_for(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")


def items_for(spark):
    return spark.createDataFrame([(1, "a passage that is nowhere at all in these texts"), (2, None), (3, "short")], "item_id long, text string")


OPERATORS = {
    "packing": lambda spark, d: packing.pack(d).groupBy("doc_id", "ids").count(),
    "toxicity": lambda spark, d: toxicity.with_toxicity(d, toxicity.train(d, labels_for(spark))),
    "toxicity_filter": lambda spark, d: toxicity.without_toxic(d, toxicity.train(d, labels_for(spark))),
    "language_model": lambda spark, d: language_model.language_scores(d),
    "lengths": lambda spark, d: lengths.token_lengths(d),
    "weighted_sampling": lambda spark, d: weighted_sampling.neighbour_likeness(d),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "pii": lambda spark, d: pii.find_personal_data(d),
    "redact": lambda spark, d: pii.redact(d),
    "contamination_filter": lambda spark, d: decontaminate.without_contamination(d, items_for(spark)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_are_all_judged(name, spark, documents):
    got = OPERATORS[name](spark, documents(ODD)).collect()
    assert len(got) == len(ODD) if name != "packing" else len(got) >= 6


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables_give_no_rows(name, spark, documents):
    assert OPERATORS[name](spark, documents(ODD).limit(0)).collect() == []


def test_no_passages_in_odd_rows_or_without_items(spark, documents):
    assert decontaminate.contaminated_passages(documents(ODD), items_for(spark)).collect() == []
    assert decontaminate.contaminated_passages(documents(ODD), items_for(spark).limit(0)).collect() == []
    assert decontaminate.without_contamination(documents(ODD), items_for(spark).limit(0)).count() == len(ODD)


def test_short_items_are_found_as_they_are(spark, documents):
    items = spark.createDataFrame([(1, "Same"), (2, "E T"), (3, ""), (4, None), (5, "é漢🙂"), (6, "aa"), (7, "SAME"), (8, "here at least nine")], "item_id long, text string")
    rows = [*ODD, (20, "Aaaa, and aa"), (21, "HERE AT LEAST NINE")]
    got = {(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.contaminated_passages(documents(rows), items).collect()}
    want = {(d, i, 0, 4, 0) for d in (3, 4) for i in (1, 7)} | {(3, 2, 3, 6, 0), (4, 2, 3, 6, 0), (None, 2, 3, 6, 0), (7, 5, 0, 3, 0)}
    # of places that overlap the first counts
    assert got == want | {(20, 6, 0, 2, 0), (20, 6, 10, 12, 0), (21, 8, 0, 18, 0)}
    kept = decontaminate.without_contamination(documents(rows), items).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "5", "6", "None"]


def test_sums_of_no_lengths(spark):
    none = spark.createDataFrame([], "length long")
    assert lengths.suffix_sums(lengths.length_histogram(none)).collect() == []


def test_near_duplicate_filter_keeps_one_row_of_each_component(spark, documents):
    rows = [*ODD, *[(100 + i, " ".join(f"w{j}" for j in range(400)) + f" {i % 7}") for i in range(40)]]
    found = {}
    for r in simhash.near_duplicates(documents(rows)).collect():
        found.setdefault(r.component_id, []).append(r.doc_id)
    kept = [r.doc_id for r in simhash.without_near_duplicates(documents(rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, found))
    assert simhash.without_near_duplicates(documents(rows).limit(0)).collect() == []
    # of rows with one id only the first stays, and the columns are as they were
    same = simhash.without_near_duplicates(documents([(3, "same text"), (3, "same text")]))
    assert same.columns == documents([]).columns and same.count() == 1


# --- packing ---------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 40))
def test_fill_is_the_best_subset_sum(counts, room):
    used = packing.fill(counts, room)
    assert all(0 < n <= counts[x] for x, n in used.items())
    best = max(
        s
        for choice in itertools.product(*[range(n + 1) for n in counts.values()])
        if (s := sum(a * b for a, b in zip(choice, counts, strict=True))) <= room
    )
    assert sum(x * n for x, n in used.items()) == best


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_windows_use_every_piece_once(counts):
    left = dict(counts)
    for pattern, repeats in packing.plan_windows(counts, 64):
        assert sum(x * n for x, n in pattern.items()) <= 64 and repeats > 0
        for x, n in pattern.items():
            left[x] -= n * repeats
    assert not any(left.values())


def test_pieces_decode_to_the_texts(spark, documents):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(ODD[i] for i in (1, 4, 6, 7, 9)) | {8: "hello there " * 3000}
    packed = packing.pack(documents(list(texts.items())), capacity=512).collect()
    for doc, text in texts.items():
        cut = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in packed if r.doc_id == doc)
        ids = [i for _, part in cut for i in part]
        assert ids[-1] == 1 and tokenizer.decode(ids[:-1]) == text


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  <|endoftext|>z", "<|endoftext| > a", " <|endoftext|>  b c"])
def test_added_tokens_in_texts_have_their_own_id(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(tokens.vocabulary_path()).encode(text), "<u4").tolist() == want


def test_places_are_whole_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    cut = spark.createDataFrame([(i, rng.choice([5, 5, 5, 9, 64, 33])) for i in range(300)], "doc_id long, length long")
    at = {}
    for r in packing.place(cut, 64).collect():
        for x in range(r.offset, r.offset + r.length):
            assert at.setdefault((r.sequence_id, x), r.doc_id) == r.doc_id
    assert len(at) == sum(r.length for r in cut.collect())


PIECES = st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "\u00a0", "\x85", "\x1c", "'s", "12", "½", "é", "漢", "🙂", ".", "!!", "\u200b", "\r", "\u2028"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=15).map("".join))
def test_encoder_gives_the_vocabularys_ids(text):
    from functools import cache

    import public_tokenizers
    from tokenizers import Tokenizer

    @cache
    def tokenizer():
        return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    want = _tokenizer(tokenizer).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(tokens.vocabulary_path()).encode(text), "<u4").tolist() == want


_KEPT = {}


def _tokenizer(make):
    return _KEPT.setdefault("tokenizer", _KEPT.get("tokenizer") or make())


# --- token counts ----------------------------------------------------------------------------------------------------


def test_totals_at_any_limit(spark):
    found = [3, 3, 500, 700, 700, 10_000]
    sums = lengths.suffix_sums(lengths.length_histogram(spark.createDataFrame([(n,) for n in found], "length long")))
    limits = [1, 3, 4, 600, 700, 9_999, 20_000]
    got = {r["limit"]: r for r in lengths.totals_at(sums, spark.createDataFrame([(x,) for x in [*limits, None]], "`limit` long")).collect()}
    assert set(got) == set(limits)
    for x in limits:
        assert got[x].documents_from == sum(n >= x for n in found)
        assert got[x].truncated_total == sum(min(n, x) for n in found)


# --- toxicity --------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]] if False else [i] + [0] * len(b) if False else _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


WORD = st.text("abc", min_size=1, max_size=8)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(WORD, st.floats(0.5, 5), min_size=1, max_size=8), WORD)
def test_automaton_and_trie_find_terms_within_one_edit(terms, word):
    exact, fuzzy = toxicity.near_terms(toxicity.build_trie(terms), word)
    assert exact == terms.get(word, 0.0)
    assert fuzzy == max((w for t, w in terms.items() if len(t) >= toxicity.FUZZY_LENGTH and edits(t, word) == 1), default=0.0)
    match = toxicity.Matcher(toxicity.Lexicon(tuple(sorted(terms.items())), ()))
    if not exact and len(word) >= toxicity.FUZZY_LENGTH - 1:
        assert (match.match(word) or (0.0, False))[0] == pytest.approx(fuzzy * toxicity.FUZZY_SHARE)


def test_quotations_are_summed_apart():
    match = toxicity.Matcher(toxicity.Lexicon((("scoundrel", 4.0),), (("villain", 3.0),)))
    abuse = toxicity.features("you scoundrel, you villainous man", match)
    misspelt = toxicity.features("you scoundrle, you scoundrell", match)
    quoted = toxicity.features('they were told "no scoundrel may enter" at the door', match)
    assert abuse[0] > 0 and abuse[1] == 0 and abuse[2] == 0
    assert misspelt[0] == 0 and misspelt[1] > 0
    assert quoted[0] == 0 and quoted[2] > 0 and quoted[3] == 0


def test_model_learns_words_and_leaves_clean_texts(spark, documents):
    clean = [(i, f"plain words about matter number {i}") for i in range(200)]
    toxic = [(1000 + i, f"what a scoundrel number {i} is") for i in range(60)]
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = documents(clean + toxic + [(5000, "such a scoundrle"), (5001, "nothing of note")])
    model = toxicity.train(docs, labels)
    score = {r.doc_id: r["~s"] for r in toxicity.with_toxicity(docs, model, ["doc_id"], "~s").collect()}
    assert min(score[i] for i, _ in toxic) > 0.5 > max(score[i] for i, _ in clean)
    assert score[5000] > score[5001]
    assert {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} >= {i for i, _ in clean} | {5001}


# --- chat ------------------------------------------------------------------------------------------------------------


def test_texts_and_roles_come_back_from_the_template(spark):
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "\n", "~0", "~1", "~", "s>", "INST]", "x"]
    rng = random.Random(2)
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", rng.choice(made), None]), rng.choice([*made, None])))
    rows += [(99, 0, "user", "same"), (99, 0, "user", "same"), (None, None, "assistant", LONG)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    examples = chat.chat_examples(frame)
    got = examples.select(
        "conv_id", "example", "whole", chat.parsed_turns(F.col("text")).alias("turns"),
        chat.trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    ).collect()
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = [(r, x) for _, _, r, x in turns]
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        assert [tuple(t) for t in mine[-1].turns] == turns and mine[-1].whole
        assert [r.loss for r in mine if r.turns[-1].role == "assistant"] == [x for r, x in turns if r == "assistant"]
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        assert [len(r.turns) - 1 for r in mine] == ends
    assert chat.chat_examples(frame.limit(0)).collect() == []


# --- decontamination -------------------------------------------------------------------------------------------------


def test_passages_within_the_budget_are_found_and_no_others():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [text(rng.randint(40, 200)) for _ in range(12)]
    index = decontaminate.Index(items)
    for _ in range(60):
        which = rng.randrange(len(items))
        changed = list(items[which])
        budget = decontaminate.edit_budget(len(changed))
        done = rng.randint(0, budget)
        for _ in range(done):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], [rng.choice(letters)], [changed[at], rng.choice(letters)]])
        before, after = text(rng.randint(0, 300)), text(rng.randint(0, 300))
        found = index.matches(before + "".join(changed).upper() + after)
        assert [m.item for m in found] == [which]
        assert found[0].edits <= done
        assert abs(found[0].start - len(before)) <= budget and abs(found[0].end - len(before) - len(changed)) <= budget
    assert index.matches(text(5000)) == []


def test_alignment_matches_a_full_table():
    rng = random.Random(8)
    for _ in range(80):
        item = "".join(rng.choice("ab") for _ in range(rng.randint(8, 20)))
        text = "".join(rng.choice("ab") for _ in range(rng.randint(8, 40)))
        # the whole text is inside the band, so the least edits of any passage are found
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        points = decontaminate.code_points
        got = decontaminate.align(points(text), points(item), -40, 120, 40)
        assert got[2] == min(row)
        assert edits(item, text[got[0] : got[1]]) == got[2]


def test_blocks_of_the_benchmark_are_passes_of_their_own(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (60,))
    items = spark.createDataFrame([(i, f"question number {i} of the benchmark that nobody may see") for i in range(5)], "item_id long, text string")
    docs = documents([(i, f"intro. question number {i} of the benchmark that nobody may see. outro") for i in range(3)] + [(9, "clean")])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_passages(docs, items).collect() if r.edits == 0}
    assert got == {(0, 0), (1, 1), (2, 2)}
    assert [r.doc_id for r in decontaminate.without_contamination(docs, items).collect()] == [9]


# --- language model --------------------------------------------------------------------------------------------------


def test_units_and_code_can_be_read_back():
    for text in (b"", b" ", b"a", b"a b\n\n c", "é \x00x".encode()):
        found = language_model.units(text)
        assert b"".join(found) == text + b"\xff"
        assert all(not u[:-1].strip() or b" " not in u[:-1] for u in found)
    code = language_model.prefix_code([5, 0, 0, 9] + [0] * 252)
    paths = ["".join(str(b) for b in code.bits[s : s + n]) for s, n in zip(code.start, code.size, strict=True)]
    assert sum(0.5**n for n in code.size) == pytest.approx(1)
    assert not any(a != b and b.startswith(a) for a in paths[:20] for b in paths[:20])


def test_probabilities_of_all_next_bytes_sum_to_one():
    code = language_model.prefix_code([1] * 256)
    tables = np.zeros((len(language_model.CONTEXTS), 2 << language_model.SLOT_BITS), np.int64)
    language_model.add_counts(tables, [b"the ", b"then ", b"cat\xff"], np.array([5, 2, 3]), code)
    pairs = tables.reshape(len(language_model.CONTEXTS), -1, 2)
    levels = np.round(np.log((pairs[:, :, 1] + 0.4) / (pairs[:, :, 0] + 0.4)) * language_model.SCALE).astype(np.int8)
    known = np.minimum(9, np.log2(pairs[0].sum(axis=1) + 1)).astype(np.int8)
    model = language_model.new_model(code, levels, known)
    for start in (b"", b"th", b"zz"):
        # the cost of a byte after a beginning, both taken from one block
        with_byte = np.array([model.bits(p) for p in model.packed([start + bytes([b]) for b in range(256)])])
        alone = model.bits(model.packed([start])[0]) if start else 0.0
        assert (0.5 ** (with_byte - alone)).sum() == pytest.approx(1, rel=1e-6)


def test_match_model_shortens_repeats_only():
    line = [f"word{i} ".encode() for i in range(30)]
    bits, rest = language_model.match_bits(line * 5)
    assert rest[:30] == line and len(rest) < 40 and bits < 60
    assert language_model.match_bits(line) == (0.0, line)


def test_common_and_rare_words_have_the_same_counts(spark, documents, monkeypatch):
    rows = [(i, f"the the cat{i % 7} and Dog{i % 50}") for i in range(300)]
    key = lambda r: r.doc_id
    every = sorted(language_model.language_scores(documents(rows)).collect(), key=key)
    monkeypatch.setattr(language_model, "COMMON_WORDS", 3)
    few = sorted(language_model.language_scores(documents(rows)).collect(), key=key)
    for a, b in zip(every, few, strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.n_tokens, b.n_known, b.train_tokens)
        assert a.base_score == pytest.approx(b.base_score)


def test_one_occurrence_less_is_what_the_other_counts_give():
    m = language_model
    for zeros, ones in ((1, 0), (0, 1), (2, 0), (3, 1), (1, 4), (5, 1)):
        level = round(np.log((ones + m.PRIOR) / (zeros + m.PRIOR)) * m.SCALE)
        known = int(np.log2(zeros + ones + 1))
        for bit, (z, o) in enumerate(((zeros - 1, ones), (zeros, ones - 1))):
            if z >= 0 and o >= 0:
                assert m.LESS[0][bit, known, level + 128] == round(np.log((o + m.PRIOR) / (z + m.PRIOR)) * m.SCALE)
                assert m.LESS[1][bit, known, level + 128] == int(np.log2(z + o + 1))


def test_lots_of_texts_are_scored_as_each_alone(monkeypatch):
    """The match model reads whole lots; each text costs what it does when its units are read one by one."""
    m = language_model
    rng = np.random.default_rng(5)
    texts = [b" ".join(rng.choice([b"a", b"bb", b"c", b"the", b"of"], n)) for n in rng.integers(0, 60, 80)]
    texts += [b"", b" ", b"\xff \xff", b"the end\n" * 40, b"w " * 5]
    found, many = m.split(texts)
    found = found.dictionary_encode()
    distinct, unit = found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)
    bits, left = m.matches(unit, many)

    def one_by_one(text):
        hits, tries, seen = [0.1, 2.0, 3.0, 3.6], [4.0] * 4, {}
        cost, rest, at, length, before = 0.0, [], 0, 0, None
        for i, u in enumerate(text):
            if at:
                kind, hit = min(length, 3), u == text[at]
                chance = hits[kind] / tries[kind]
                cost -= np.log2(chance if hit else 1 - chance)
                tries[kind] += 1
                hits[kind] += hit
                at, length = (at + 1, length + 1) if hit else (0, 0)
            else:
                hit = False
            if not hit:
                rest.append(u)
            at = at or seen.get((before, u), 0)
            seen[before, u] = i + 1
            before = u
        return cost, rest

    end = np.cumsum(many)
    for text, a, b, cost in zip(texts, end - many, end, bits, strict=True):
        want, rest = one_by_one(m.units(text))
        assert cost == pytest.approx(want)
        assert rest == [distinct[u] for u, stays in zip(unit[a:b], left[a:b], strict=True) if stays]

    code = m.prefix_code([1] * 256)
    levels = rng.integers(-120, 120, (len(m.CONTEXTS), 1 << m.SLOT_BITS)).astype(np.int8)
    model = m.new_model(code, levels, rng.integers(0, m.LEVELS, 1 << m.SLOT_BITS).astype(np.int8))
    together = m.Cache(model).costs(distinct, unit, many)
    alone = [one_by_one(m.units(t)) for t in texts]
    assert together == pytest.approx([cost + model.bits(b"".join(model.packed(rest))) for cost, rest in alone])
    monkeypatch.setattr(m, "CACHED_UNITS", 3)
    small = m.Cache(model)
    assert all(small.costs(distinct, unit, many) == pytest.approx(together) and len(small) <= 3 for _ in range(3))


def test_bytes_of_an_array_as_a_list():
    for values in ([], [b""], [b"a", b"", b"\xff\x00b"], [b"x" * 300, b"yy"]):
        for kind in (pa.binary(), pa.large_binary()):
            found = pa.array(values, kind)
            assert language_model.octets(found) == values
            assert language_model.octets(found.slice(1)) == values[1:]


def test_what_a_share_learns_from_is_looked_up_for_many_steps(monkeypatch):
    """A step of the weights takes few units, but slots are not looked up anew for each; steps see units in their order."""
    m = language_model
    batch = [f"word{i} ".encode() for i in range(10 * m.LEARNT_AT_ONCE)]
    code = m.prefix_code([1] * 256)
    tables = np.zeros((len(m.CONTEXTS), 2 << m.SLOT_BITS), np.int32)
    times = np.arange(1, len(batch) + 1)
    m.add_counts(tables, batch, times, code)
    zeros, ones = tables.reshape(len(m.CONTEXTS), -1, 2).transpose(2, 0, 1)
    levels = np.round(np.clip(np.log((ones + m.PRIOR) / (zeros + m.PRIOR)), -m.LIMIT, m.LIMIT) * m.SCALE).astype(np.int8)
    known = np.minimum(m.LEVELS - 1, np.log2(zeros + ones + 1)).astype(np.int8).ravel()
    model = m.new_model(code, levels, known)
    calls = []
    look_up = m.unit_bits
    monkeypatch.setattr(m, "unit_bits", lambda *args: calls.append(1) or look_up(*args))
    weights, seen = model.online(batch, times, 1)
    assert len(calls) < 5
    monkeypatch.setattr(m, "UNITS_AT_ONCE", m.LEARNT_AT_ONCE)
    same, as_many = model.online(batch, times, 1)
    assert np.array_equal(weights, same) and np.array_equal(seen, as_many)


def test_all_training_units_teach_and_counts_pass_32_bits(spark, monkeypatch):
    """Weights come from every unit, in any number of shares, and tables of 32 bits are handed on before they are full."""
    m = language_model
    rows = [(f"word{i} ".encode(), 1 + 40_000 // (i + 1)) for i in range(400)]
    counted = spark.createDataFrame(rows, "unit binary, n long")
    code = m.prefix_code(m.symbol_counts(counted))
    levels, known = m.slot_tables(counted, code)
    first = m.new_model(code, levels, known)
    one = m.taught(first, counted)
    half = m.taught(first, counted.limit(200))
    assert not np.array_equal(one.weights, half.weights) and not np.array_equal(one.weights, first.weights)
    monkeypatch.setattr(m, "SHARE_UNITS", 50)
    assert np.isfinite(m.taught(first, counted).weights).all()
    many = spark.createDataFrame([(b"aa ", 5_000_000_000), (b"b ", 3)], "unit binary, n long")
    whole = m._slot_counts(many, code).groupBy("slot").sum("zeros", "ones").collect()
    assert max(r[1] + r[2] for r in whole) == 5_000_000_003


# --- URL filters -----------------------------------------------------------------------------------------------------


def test_urls_against_every_rule(spark):
    rules = [("net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/y/", "block"), ("org", None, "block"), ("Org", "/ok/", "allow"), (None, "/", "block")]
    urls = ["http://b.A.net/x/y/z?q#f", "https://a.net/x/y", "x://a.net", "a.net/x/", None, "", "http://ba.net/x/", "http://u.org/ok/1", "http://org/ok", "://net/", "http://" + "l." * 3000 + "net/" + "p/" * 3000]
    frame = spark.createDataFrame([(i, u, "keep") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string").withColumnRenamed("rule", "short")
    got = {r.page_id: r for r in url_filter.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls) + 1
    kept = [((h or "").lower(), p or "/", v) for h, p, v in rules if h is not None]
    for i, url in enumerate([*urls, urls[0]]):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h + p), h + p, v) for h, p, v in kept if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit)[1:] if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].short) == (host, path, *want, "keep")
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge_urls(frame, empty).collect()} == {"allow"}
    with pytest.raises(Exception, match="must begin and end"):
        url_filter.judge_urls(frame, spark.createDataFrame([("net", "/x", "block")], "host string, path string, verdict string")).collect()


# --- SimHash ---------------------------------------------------------------------------------------------------------


def linked(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


def clustered_marks(rng, size):
    """Fingerprints of which many are near each other and share blocks."""
    seeds = [rng.getrandbits(64) for _ in range(6)]
    return sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for s in seeds for _ in range(size)})


@pytest.mark.parametrize("bits", [0, 1, 2, 4])
def test_index_search_finds_all_pairs(bits):
    marks = clustered_marks(random.Random(bits), 80)

    def gray_rank(x):
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> s
        return x

    marks = np.array(sorted(marks, key=gray_rank), np.uint64)
    who, found = simhash.search(marks, marks, bits)
    want = {(i, j) for i in range(len(marks)) for j in range(len(marks)) if int(marks[i] ^ marks[j]).bit_count() <= bits}
    assert set(zip(who.tolist(), found.tolist(), strict=True)) == want
    a, b = simhash.spanning_links(marks, bits)
    every = [(int(marks[i]), int(marks[j])) for i, j in want]
    assert linked(zip(a.tolist(), b.tolist(), strict=True), marks.tolist()) == linked(every, marks.tolist())


@pytest.mark.parametrize(("bits", "members"), [(2, 20_000), (2, 40), (6, 20_000)])
def test_divided_nodes_lose_no_link(spark, bits, members):
    marks = clustered_marks(random.Random(5), 60)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fingerprint long")
    got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.fingerprint_links(frame, bits, members).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    want = [(a, b) for a in marks for b in marks if (a ^ b).bit_count() <= bits]
    assert linked(got, marks) == linked(want, marks)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (5, 4), (5, 4)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
