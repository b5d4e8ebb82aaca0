"""Conversation structure repair as shortest paths, found by an auction.

A conversation is in order if the first letters of its roles spell ``(s?(ua)+)?``. Its rows can be kept, given another
role, deleted, and empty turns can be put between them, each at a whole cost. The edits of a conversation are paths
through a lattice: a layer for each place between two rows, and in it a node for each state of the wanted pattern. Each
node has a price. A path grows from the start along the arc that is cheapest by cost and price; where that arc costs more
than the node's price allows, the price is raised and the path taken back by one node. When the path has reached the end,
the prices are dual to the distances: exactly the arcs of cheapest paths, and dead ends, are tight. Of the tight paths to
the end the one with the least letters is traced.

Conversations have no greatest length, so the lattice is cut at every 64th place. Chunks are solved apart: first each
chunk's costs from state to state, then, from the end of the conversation to its start, what is left to pay in each state
behind a chunk, then each chunk's edits for each state that it can be entered in. Only the running states pass through a
conversation in order, its rows pass by and are never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tables import written

#: Places of a chunk, and of an Arrow group of chunks, as powers of two.
CHUNK_BITS, GROUP_BITS = 6, 12

#: Costs of edits: fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
#: What is left to pay behind the last row, and the letters of the turns that are put there.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

#: First faults of a row.
NONE, BLANK, DUPLICATE, CUT = range(4)

ROLES = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\v\f\r"


def follows(state: int, initial: str) -> int | None:
    """The state after a role with this first letter, or None where the pattern has no such turn."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def wanted(state: int) -> int:
    """The state after the turn that can be given or put in any state: an assistant's after a user's, else a user's."""
    return ASSISTANT if state == USER else USER


# --- one chunk ------------------------------------------------------------------------------------------------------

Arc = tuple[int, str, int]


def lattice(rows: list[tuple[str, int]]) -> list[list[Arc]]:
    """Arcs (cost, letter, node) of each node of a chunk of rows (first letter, fault); a node is layer * 4 + state.

    The layer behind the last row has no arcs; turns put there belong to the next chunk. Letters lead from a node to at
    most one other.
    """
    arcs: list[list[Arc]] = []
    for layer, (initial, fault) in enumerate(rows):
        here, there = layer * STATES, (layer + 1) * STATES
        extra = TRUNCATED if fault == CUT else 0
        for state in range(STATES):
            out = [(DELETE, "D", there + state), (INSERT, "I", here + wanted(state))]
            if fault not in (BLANK, DUPLICATE):
                kept = follows(state, initial)
                if kept is not None:
                    out.append((extra, "K", there + kept))
                out.append((REROLE + extra, "R", there + wanted(state)))
            arcs.append(out)
    return arcs + [[] for _ in range(STATES)]


def auction(arcs: list[list[Arc]], prices: list[int], origin: int, target: int, most: int) -> int | None:
    """The least cost from ``origin`` to ``target``; ``prices`` are raised on the way and may be used again.

    Prices hold ``price[i] <= cost + price[j]`` for all arcs from first to last. A price beyond ``most`` says that there
    is no way from that node: no cheapest path costs more.
    """
    path = [origin]
    while True:
        node = path[-1]
        if node == target:
            return prices[origin] - prices[target]
        least, after = most + 1, -1
        for cost, _, to in arcs[node]:
            if cost + prices[to] < least:
                least, after = cost + prices[to], to
        if prices[node] < least:
            prices[node] = least
            if node != origin:
                path.pop()
            elif least > most:
                return None
        elif after < 0:
            # the origin is known to have no way to the target
            return None
        else:
            path.append(after)


def trace(arcs: list[list[Arc]], prices: list[int], origin: int, target: int) -> tuple[str, int]:
    """The least letters of the tight paths between two nodes, and the node before ``target``.

    The search goes by letters in their order; a node from which it had to come back is a dead end for all paths.
    """
    dead: set[int] = set()
    path: list[tuple[int, str]] = [(origin, "")]
    tight: dict[int, Iterator[Arc]] = {}
    while path[-1][0] != target:
        node = path[-1][0]
        if node not in tight:
            tight[node] = iter(sorted((a for a in arcs[node] if prices[node] == a[0] + prices[a[2]]), key=lambda a: a[1]))
        step = next((a for a in tight[node] if a[2] not in dead), None)
        if step is None:
            dead.add(node)
            path.pop()
        else:
            path.append((step[2], step[1]))
    return "".join(letter for _, letter in path), path[-2][0]


def _most(rows: int) -> int:
    """No path costs more than to delete all rows, put a user's and an assistant's turn, and pay what the end asks."""
    return DELETE * rows + 4 * INSERT


def costs(rows: list[tuple[str, int]]) -> list[int | None]:
    """The least cost of a chunk from each state before it to each state behind it (row by row), None where no way is."""
    arcs, last = lattice(rows), len(rows) * STATES
    out: list[list[int | None]] = [[None] * STATES for _ in range(STATES)]
    for target in range(STATES):
        prices = [0] * len(arcs)
        for origin in range(STATES):
            out[origin][target] = auction(arcs, prices, origin, last + target, _most(len(rows)))
    return [c for row in out for c in row]


def edits(rows: list[tuple[str, int]], origin: int, left: list[int]) -> tuple[str, int]:
    """The letters of the cheapest edits of a chunk entered in ``origin``, and the state behind it.

    ``left`` is what is left to pay in each state behind the chunk, or how much more than in the cheapest of them.
    """
    arcs = lattice(rows)
    target = len(arcs)
    for state in range(STATES):
        arcs[target - STATES + state].append((left[state], "", target))
    arcs.append([])
    prices = [0] * len(arcs)
    if auction(arcs, prices, origin, target, _most(len(rows)) + max(left)) is None:
        raise ValueError("a conversation can always be repaired by deleting its rows")
    letters, before = trace(arcs, prices, origin, target)
    return letters, before - (target - STATES)


# --- conversations of any length ------------------------------------------------------------------------------------


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (a stored table with ~pos, conv_id, ~key and the text) narrowed to ~pos, conv_id, ~initial and ~fault."""
    # the first row with a role and text, by conversation: copies are counted up before they are shuffled
    first = turns.groupBy("conv_id", "~key").agg(F.min("~pos").alias("~pos")).select("~pos", F.lit(True).alias("~first"))
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(text == "", BLANK)
        .when(F.col("~first").isNull(), DUPLICATE)
        .when(~F.substring(text, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(NONE)
    )
    return turns.join(first, "~pos", "left").select("~pos", "conv_id", F.substring("role", 1, 1).alias("~initial"), fault.alias("~fault"))


def _chunks(marked: DataFrame) -> DataFrame:
    """One row for each chunk: conv_id, ~chunk, its rows' ``initials`` and ``faults``, and its ``costs``.

    A chunk is the part of a conversation in one run of ``1 << CHUNK_BITS`` places, so a conversation has a row at least.
    A chunk with other conversations on both sides is whole and is only entered at the start: its costs are null.
    """
    kind = marked.schema["conv_id"].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group.column(i).to_pylist() for i in range(4)], strict=True))
        out: dict[str, list] = {"conv_id": [], "~chunk": [], "initials": [], "faults": [], "costs": []}
        start = 0
        for i in range(1, len(rows) + 1):
            here = rows[start]
            if i < len(rows) and rows[i][1] == here[1] and rows[i][0] >> CHUNK_BITS == here[0] >> CHUNK_BITS:
                continue
            part = [(initial, fault) for _, _, initial, fault in rows[start:i]]
            out["conv_id"].append(here[1])
            out["~chunk"].append(here[0] >> CHUNK_BITS)
            out["initials"].append([p[0] for p in part])
            out["faults"].append([p[1] for p in part])
            whole = 0 < start and i < len(rows) and rows[start - 1][1] != here[1] != rows[i][1]
            out["costs"].append(None if whole else costs(part))
            start = i
        return pa.Table.from_pydict(out, schema=pa.schema([
            ("conv_id", group.schema.field("conv_id").type), ("~chunk", pa.int64()), ("initials", pa.list_(pa.string())),
            ("faults", pa.list_(pa.int32())), ("costs", pa.list_(pa.int32())),
        ]))

    grouped = marked.select("~pos", "conv_id", "~initial", "~fault").groupBy(F.shiftright("~pos", GROUP_BITS).alias("~group"))
    return grouped.applyInArrow(solve, f"conv_id {kind}, `~chunk` long, initials array<string>, faults array<int>, costs array<int>")


def _and_then(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        yield from map(list, zip(*[c.to_pylist() for c in batch.columns], strict=True))


def _batches(rows: Iterator[list], schema: pa.Schema, size: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and length of text."""
    held: list[list] = []
    length = 0

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        held.clear()
        return batch

    for row in rows:
        held.append(row)
        length += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or length > chars:
            yield flush()
            length = 0
    if held:
        yield flush()


def _schema(df: DataFrame, fields: str) -> tuple[str, Callable[[pa.Schema], pa.Schema]]:
    """The schema text of ``df`` with ``fields`` behind it, as Spark and as Arrow take it."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    added = [f.rsplit(" ", 1) for f in fields.split(", ")]
    text = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields) + ", ".join(f"`{n}` {k}" for n, k in added)
    return text, lambda schema: pa.schema([*schema, *[(n, kinds[k]) for n, k in added]])


def _left_to_pay(chunks: DataFrame) -> DataFrame:
    """Adds ``left``: what each state behind a chunk costs more, to the conversation's end, than the cheapest of them."""
    text, typed = _schema(chunks, "left array<int>")
    at = chunks.columns.index("costs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows(first: pa.RecordBatch) -> Iterator[list]:
            conversation: object = run
            left: list[int] = []
            for row in _rows(_and_then(first, batches)):
                if row[0] != conversation:
                    conversation, left = row[0], [c for c, _ in END]
                yield [*row, left]
                if (cost := row[at]) is None:
                    continue
                left = [min(cost[a * STATES + b] + left[b] for b in range(STATES) if cost[a * STATES + b] is not None) for a in range(STATES)]
                # only differences decide, and low costs make short auctions
                left = [c - min(left) for c in left]

        for first in batches:
            schema = typed(first.schema)
            yield from _batches(rows(first), schema)

    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("~chunk"))
    return dealt.mapInArrow(run, text)


def _plans(chunks: DataFrame) -> DataFrame:
    """Adds, for each state a chunk can be entered in (a whole conversation: only the start), the ``letters`` of its edits and the state ``after`` them."""
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, after = [], []
            for initials, found, left, cost in zip(*[batch.column(c).to_pylist() for c in ("initials", "faults", "left", "costs")], strict=True):
                entered = [START] if cost is None else range(STATES)
                plans = [edits(list(zip(initials, found, strict=True)), state, left) for state in entered]
                letters.append([p[0] for p in plans])
                after.append([p[1] for p in plans])
            columns = [pa.array(letters, pa.list_(pa.string())), pa.array(after, pa.list_(pa.int32()))]
            known = [batch.column(c) for c in ("conv_id", "~chunk", "faults")]
            yield pa.RecordBatch.from_arrays([*known, *columns], ["conv_id", "~chunk", "faults", "letters", "after"])

    dealt = chunks.repartition("conv_id", "~chunk")
    return dealt.mapInArrow(run, f"conv_id {kind}, `~chunk` long, faults array<int>, letters array<string>, after array<int>")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as a stored table with a place ~pos in the order of conversations and turns.

    Null roles and texts are one space. Null turns come first; turns of one number are ordered by role, then by a digest
    of both. Ranges of this order are sorted apart, and equal rows are spread over ranges, so no conversation and no group
    of copies meets in one task.
    """
    space = F.lit(" ")
    plain = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    keyed = plain.withColumn("~key", F.unhex(F.sha2(F.concat_ws("\n", "role", "text"), 256))).withColumn("~spread", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "~key", "~spread")]
    return written(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("~spread").withColumn("~pos", F.monotonically_increasing_id()),
        "turns",
    )


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits that bring each conversation into order, one row per edit.

    ``turns`` has conv_id, turn, role and text, other columns are left out. The result has conv_id, ``edit`` (K: kept,
    R: given another role, D: deleted, I: put in), ``cost``, ``turn``, ``role`` and ``text`` as they were (null for I),
    ``fault`` (0: none, 1: blank, 2: duplicate, 3: truncated, the first that holds), ``new_role`` and ``new_text`` (null
    for D). Rows of one conversation come together, in order, in one partition. Among edits of one cost the ASCII-least
    letters are taken. Rows with a null conv_id are one conversation; an empty table gives no rows. A role that is empty
    or starts with another letter than s, u or a fits nowhere and is replaced or deleted.
    """
    stored = ordered_turns(turns)
    chunks = _chunks(faults(stored))
    return _applied(stored, _plans(written(_left_to_pay(chunks), "chunks")))


def _applied(stored: DataFrame, plans: DataFrame) -> DataFrame:
    """The edits of ``plans`` with the rows they change. A chunk's plan comes just before its rows, in one pass by."""
    kind = stored.schema["conv_id"].dataType.simpleString()
    null = F.lit(None)
    heads = plans.select(
        "conv_id", "~chunk", F.lit(-1).cast("long").alias("~pos"), null.cast("long").alias("turn"),
        null.cast("string").alias("role"), null.cast("string").alias("text"), "letters", "after", "faults",
    )
    bodies = stored.select(
        "conv_id", F.shiftright("~pos", CHUNK_BITS).alias("~chunk"), "~pos", "turn", "role", "text",
        null.cast("array<string>").alias("letters"), null.cast("array<int>").alias("after"), null.cast("array<int>").alias("faults"),
    )
    dealt = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "~chunk", "~pos")
    fields = f"conv_id {kind}, edit string, cost int, turn long, role string, text string, fault int, new_role string, new_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(first: pa.RecordBatch) -> Iterator[list]:
            conversation: object = run
            state, behind, letters, found = START, START, "", iter(())

            def put_in() -> Iterator[list]:
                nonlocal state, letters
                while letters.startswith("I"):
                    state, letters = wanted(state), letters[1:]
                    yield [conversation, "I", INSERT, None, None, None, None, ROLES[state], ""]

            for conv, _, pos, turn, role, text, plan, after, chunk_faults in _rows(_and_then(first, batches)):
                if conv != conversation:
                    letters = END[behind][1]
                    yield from put_in()
                    conversation, behind = conv, START
                if pos < 0:
                    state, letters, found = behind, plan[behind], iter(chunk_faults)
                    behind = after[behind]
                    continue
                yield from put_in()
                edit, letters, fault = letters[0], letters[1:], next(found)
                extra = TRUNCATED if fault == CUT else 0
                if edit == "D":
                    yield [conv, edit, DELETE, turn, role, text, fault, None, None]
                elif edit == "K":
                    state = follows(state, role[:1])
                    yield [conv, edit, extra, turn, role, text, fault, role, text]
                else:
                    state = wanted(state)
                    yield [conv, edit, REROLE + extra, turn, role, text, fault, ROLES[state], text]
            letters = END[behind][1]
            yield from put_in()

        for first in batches:
            text = pa.string()
            schema = pa.schema([
                ("conv_id", first.schema.field("conv_id").type), ("edit", text), ("cost", pa.int32()), ("turn", pa.int64()),
                ("role", text), ("text", text), ("fault", pa.int32()), ("new_role", text), ("new_text", text),
            ])
            yield from _batches(rows(first), schema)

    return dealt.mapInArrow(run, fields)



def digests(edited: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s result: counts of faults, ``cost``, ``audit`` and ``repaired_sha256``.

    ``gaps`` is how many whole numbers between the least and the greatest turn are no turn (0 if all are null),
    ``illegal`` how many neighbouring rows had roles that may not follow each other. ``audit`` has the letters of all
    edits, and the digest is that of ``role:text`` of all repaired rows, joined by new lines. Conversations pass by row
    by row, in the order that ``repair`` gives. An empty table gives no rows.
    """
    kind = edited.schema["conv_id"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(first: pa.RecordBatch) -> Iterator[list]:
            conversation: object = run
            for conv, edit, cost, turn, role, _, fault, new_role, new_text in _rows(_and_then(first, batches)):
                if conv != conversation:
                    if conversation is not run:
                        yield done()
                    conversation, letters, digest, apart = conv, [], hashlib.sha256(), ""
                    found, illegal, total, before = [0] * 4, 0, 0, None
                    low = high = None
                    turns = 0

                    def done() -> list:
                        gaps = high - low + 1 - turns if turns else 0
                        return [conversation, gaps, *found[1:], illegal, total, "".join(letters), digest.hexdigest()]

                letters.append(edit)
                total += cost
                if edit != "I":
                    found[fault] += 1
                    illegal += before is not None and before + role[:1] not in legal
                    before = role[:1]
                    if turn is not None and turn != high:
                        low, high, turns = turn if low is None else low, turn, turns + 1
                if new_role is not None:
                    digest.update(f"{apart}{new_role}:{new_text}".encode())
                    apart = "\n"
            if conversation is not run:
                yield done()

        for first in batches:
            whole, text = pa.int64(), pa.string()
            schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *[(n, whole) for n in names], ("audit", text), ("repaired_sha256", text)])
            yield from _batches(rows(first), schema)

    return edited.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string")
