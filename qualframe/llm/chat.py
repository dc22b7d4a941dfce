"""Conversations as training text: turns collected, sorted, merged by role and concatenated, with the spans a model learns from.

The turns of a conversation are collected as structs and sorted. Neighbours of one role become one message, an array of their texts, and
messages are concatenated between control strings::

    ### user: first text</part>second text of the same role</turn>
    ### assistant: answer</turn>

Control strings inside texts and roles are broken up by a backslash, and a backslash is doubled, so the formatted text can be read back
without loss, however often texts quote the template. The loss mask lists the texts of one role as spans of UTF-8 bytes, so that each is cut
out without walking the characters before it. Everything is a Spark expression, linear in the turns of a conversation.

A formatted conversation is one value, so the turns of one conversation meet in one task; that is what bounds its length (2 GB).

Defined results: a null text or role is empty; turns follow (turn, role, text), null turns first, so ties have one order and repeated rows are
repeated turns; rows without a conversation id are one conversation without id; an empty table gives no rows; other columns are dropped, so
names cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.common import let

HEAD, TAIL, PART, END = "### ", ": ", "</part>", "</turn>\n"
LEARNED = "assistant"
# First characters of control strings, where the rest follows, and the escape itself. A role must not hold what ends it either.
_CONTROL = r"\\|#(?=##)|<(?=/(?:part|turn)>)"
_CONTROL_IN_ROLE = _CONTROL + "|:(?= )"
_ESCAPED = r"\\([\\#/ ])"
# Sums over this many lengths are added up at a time.
BLOCK = 256


def escape(text: Column, control: str = _CONTROL) -> Column:
    """``text`` with a backslash after the first character of every control string, and after every backslash."""
    return F.regexp_replace(text, control, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _before(lengths: Column) -> Column:
    """The sum of the lengths before each element: of whole blocks first, then within the block."""
    zero = F.lit(0)
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    block = lambda i: F.call_function("div", i, F.lit(BLOCK)).cast("int")

    def sums(n: Column) -> Column:
        blocks = F.transform(F.sequence(zero, block(F.size(n) - 1)), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        heads = let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return let(heads, lambda h: F.transform(n, lambda _, i: h[block(i)] + total(F.slice(n, block(i) * BLOCK + 1, i % BLOCK))))

    return let(lengths, sums)


def _messages(turns: Column, learned: str) -> Column:
    """Sorted turns as messages: role, whether it is learned, and the texts of all neighbours with this role, escaped."""
    many = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), many - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))

    def message(starts: Column, at: Column, k: Column) -> Column:
        after = F.when(k == F.size(starts) - 1, many).otherwise(starts[F.least(k + 1, F.size(starts) - 1)])
        return F.struct(
            escape(turns[at]["role"], _CONTROL_IN_ROLE).alias("role"), (turns[at]["role"] == learned).alias("learned"),
            F.transform(F.slice(turns, at + 1, after - at), lambda t: escape(t["text"])).alias("texts"))

    return let(starts, lambda s: F.transform(s, lambda at, k: message(s, at, k)))


def _spans(messages: Column) -> Column:
    """Where the learned texts lie in the formatted text, in bytes."""
    head = lambda m, k: F.octet_length(m["role"]) + len(HEAD + TAIL) + F.when(k > 0, F.lit(len(END))).otherwise(F.lit(0))
    pieces = F.flatten(F.transform(messages, lambda m, k: F.transform(m["texts"], lambda t, j: F.struct(
        F.when(j == 0, head(m, k)).otherwise(F.lit(len(PART))).alias("lead"), F.octet_length(t).alias("length"), m["learned"].alias("learned")))))
    span = lambda p, start: F.struct((start + p["lead"]).alias("start"), p["length"].alias("length"), p["learned"].alias("learned"))
    placed = let(pieces, lambda ps: let(_before(F.transform(ps, lambda p: p["lead"] + p["length"])),
                                        lambda starts: F.transform(ps, lambda p, i: span(p, starts[i]))))
    return F.transform(F.filter(placed, lambda p: p["learned"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))


def formatted(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              learned: str = LEARNED) -> DataFrame:
    """One row per conversation: its id, ``n_messages``, ``formatted`` and ``loss`` (array of ``start`` and ``length`` in UTF-8 bytes)."""
    filled = lambda name: F.coalesce(turns[f"`{name}`"], F.lit(""))
    said = F.struct(turns[f"`{turn}`"].alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    grouped = turns.select(turns[f"`{conversation}`"].alias(conversation), said.alias("said")).groupBy(conversation).agg(
        F.sort_array(F.collect_list("said")).alias("turns"))
    merged = grouped.select(conversation, _messages(F.col("turns"), learned).alias("messages"))
    texts = F.transform("messages", lambda m: F.concat(F.lit(HEAD), m["role"], F.lit(TAIL), F.array_join(m["texts"], PART), F.lit(END)))
    return merged.select(conversation, F.size("messages").alias("n_messages"), F.array_join(texts, "").alias("formatted"),
                         _spans(F.col("messages")).alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of ``role`` and ``text``."""
    messages = F.split(text, re.escape(END).replace("\\\n", "\n"))

    def turns(message: Column, at: Column) -> Column:
        role = unescape(F.substr(message, F.lit(len(HEAD) + 1), at - len(HEAD) - 1))
        return F.transform(F.split(F.substr(message, at + len(TAIL)), PART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(let(messages, lambda found: F.transform(
        F.slice(found, F.lit(1), F.size(found) - 1), lambda m: let(F.instr(m, TAIL), lambda at: turns(m, at)))))


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    cut = lambda b, s: F.substr(b, s["start"] + 1, s["length"]).cast("string")
    return let(text.cast("binary"), lambda b: F.array_join(F.transform(loss, lambda s: unescape(cut(b, s))), ""))
