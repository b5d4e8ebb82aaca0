"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
Turns behind the last assistant turn are kept in one more example in which nothing is trainable.

The template, as fixed text::

    prompt turn      <s>[INST] role newline text [/INST]
    assistant turn   <s> text </s>

Control strings inside a text get a backslash behind their first character (``<\\s>``), and one that has backslashes
there already gets one more, so that ``unescape`` gives back any text and no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "<s>"
PROMPT = "[INST] "
PROMPT_END = " [/INST]"
REPLY = " "
REPLY_END = " </s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~")))


def _piece(turn: Column) -> Column:
    """One turn as the template writes it."""
    return F.when(turn["role"] == ASSISTANT, F.concat(F.lit(TURN + REPLY), escape(turn["text"]), F.lit(REPLY_END))).otherwise(
        F.concat(F.lit(TURN + PROMPT), _escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(PROMPT_END))
    )


def chat_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (its number), ``text``, ``loss_start``, ``loss_end``, ``whole``.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Turns are taken in the order of
    (turn, role, text), nulls first, and repeated rows count as turns. A null role or text is empty; rows with a null
    conv_id form one conversation. The reply to learn is ``text`` from ``loss_start`` up to ``loss_end``, in code points
    (both are the length of ``text`` where nothing is to be learnt). ``whole`` marks the last example, which holds
    every turn. No rows give no examples.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == ASSISTANT).alias("reply"),
            _piece(t).alias("text"),
        ),
    )
    ends = F.aggregate(
        "pieces",
        F.array().cast("array<int>"),
        lambda so_far, p: F.concat(
            so_far, F.array(F.coalesce(F.try_element_at(so_far, F.lit(-1)), F.lit(0)) + F.length(p["text"]))
        ),
    )
    last = F.size("pieces") - 1
    targets = F.filter(
        F.sequence(F.lit(0), last), lambda i: F.element_at("pieces", i + 1)["reply"] | (i == last)
    )
    start = F.when(F.col("at") > 0, F.element_at("ends", F.greatest(F.col("at"), F.lit(1)))).otherwise(0)
    end = F.element_at("ends", F.col("at") + 1)
    is_reply = F.element_at("pieces", F.col("at") + 1)["reply"]
    return (
        conversations.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", pieces.alias("pieces"))
        .select("conv_id", "pieces", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("full"), ends.alias("ends"))
        .select("conv_id", "pieces", "full", "ends", F.posexplode(targets).alias("example", "at"))
        .select(
            "conv_id",
            F.col("example").cast("long").alias("example"),
            F.substring("full", F.lit(1), end).alias("text"),
            F.when(is_reply, start + len(TURN + REPLY)).otherwise(end).alias("loss_start"),
            F.when(is_reply, end - len(REPLY_END)).otherwise(end).alias("loss_end"),
            (F.col("at") == last).alias("whole"),
        )
    )


def trained_text(text: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask, without escapes."""
    return unescape(F.substring(text, start + 1, end - start))


def parsed_turns(text: Column) -> Column:
    """An example's turns, read back: an array of (role, text)."""

    def turn(piece: Column) -> Column:
        prompt = F.substring(piece, F.lit(len(PROMPT) + 1), F.length(piece) - len(PROMPT) - len(PROMPT_END))
        role = F.substring_index(prompt, "\n", 1)
        reply = F.substring(piece, F.lit(len(REPLY) + 1), F.length(piece) - len(REPLY) - len(REPLY_END))
        is_prompt = piece.startswith(PROMPT)
        return F.struct(
            F.when(is_prompt, _unescape_role(role)).otherwise(ASSISTANT).alias("role"),
            F.when(is_prompt, unescape(F.substring(prompt, F.length(role) + 2, F.length(prompt)))).otherwise(unescape(reply)).alias("text"),
        )

    pieces = F.split(text, TURN)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), turn)
