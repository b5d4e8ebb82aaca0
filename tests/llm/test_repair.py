"""Conversation repair against a plain search over all edits."""

import collections
import functools
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.llm import queries, repair

SPACE = " \t\n\v\f\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, letters, repaired rows), by the least cost and then the least letters, from the last row to the first."""
    found = faults_of(rows)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(i, state, put):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if put < 2:
            role = "a" if state == "u" else "u"
            cost, letters, kept = best(i, role, put + 1)
            options.append((cost + 3, "I" + letters, ((role, ""), *kept)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, letters, kept = best(i + 1, state, 0)
            options.append((cost + 4, "D" + letters, kept))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                for edit, price, new in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    if (state, new[:1]) in after:
                        cost, letters, kept = best(i + 1, after[state, new[:1]], 0)
                        options.append((cost + price + extra, edit + letters, ((new, text), *kept)))
        return min(options, default=(10**9, "~", ()))

    for i in range(len(rows), 0, -1):
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, letters, kept = best(0, "", 0)
    return cost, letters, [({"u": "user", "a": "assistant"}.get(r, r), t) for r, t in kept]


def expected(rows):
    """What the query returns for one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).digest()))
    found = collections.Counter(faults_of(rows))
    turns = {t for t, _, _ in rows if t is not None}
    cost, letters, kept = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, letters, digest)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv, turn_text, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv}:{turn_text}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows, path):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    frame.write.parquet(f"{path}/conversations.parquet")
    by_conv = collections.defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_conversation_repair"](spark, str(path)).collect()}
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        assert got[conv] == expected(damage(own)), conv


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " ", "", None, "Why?", "Well!\n", "a b c", "é漢🙂."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t {rng.random()}."))
    return rows


def test_query_matches_a_search_over_all_edits(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows, tmp_path)


@pytest.mark.parametrize("seed", range(3))
def test_any_rows_in_any_order(spark, tmp_path, seed):
    rows = some_rows(seed, 60, 9) + [(None, 1, "user", "a."), (None, None, None, None), (None, 1, "user", "a.")] * 2
    check(spark, rows, tmp_path)


def test_conversations_of_many_chunks(spark, tmp_path):
    rng = random.Random(5)
    rows = some_rows(7, 5, 900) + [(77, i, rng.choice(["user", "assistant"]), rng.choice(["same.", f"t{i}.", f"t{i}"])) for i in range(700)]
    rows += [(78, 0, "user", "all the same.")] * 500
    check(spark, rows, tmp_path)


def test_empty_tables_and_no_rows_after_damage(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "a.")], tmp_path / "one")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, edit string")
    assert repair.repair(none).collect() == []
    assert repair.digests(repair.repair(none)).collect() == []


def test_repaired_rows_are_given_back_whole(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Still there?"), (1, 3, "assistant", "Yes.")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy(F.monotonically_increasing_id()).collect()
    cost, letters, kept = cheapest([r[1:] for r in rows])
    assert "".join(r.edit for r in got) == letters and sum(r.cost for r in got) == cost
    assert [(r.new_role, r.new_text) for r in got if r.new_role] == kept


@pytest.mark.parametrize("seed", range(200))
def test_auction_prices_give_the_distances(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suuaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 30))]
    plain = [(i, {"s": "system", "u": "user", "a": "assistant", "t": "tool"}[r], {0: f"{i}.", 1: " ", 2: "copy.", 3: f"{i}"}[f]) for i, (r, f) in enumerate(rows)]
    known = [(role, {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (role, _), f in zip(rows, faults_of(plain), strict=True)]
    letters, after = repair.edits(known, repair.START, [c for c, _ in repair.END])
    assert letters + repair.END[after][1] == cheapest(plain)[1]
    whole = repair.costs(known)
    assert min(whole[b] + repair.END[b][0] for b in range(4) if whole[b] is not None) == cheapest(plain)[0]
