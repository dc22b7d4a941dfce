"""Formatted conversations: read back without loss, against plain Python."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qualframe.llm import chat, queries

DDL = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", "###", "####", "##### #", "\\", "\\\\###", "</turn>", "</turn>\n", "<\\/turn>", "</part>", "#\\##", "### assistant: x</turn>\n### user: y",
         "\\### Assistant: </turn> ok", "ends with <", "</turn", "ü\U0001f600</turn>漢", "a: b", ": ", "\n", "$0 $1", "line\nline"]


def expected(rows):
    """Turns of every conversation in order, and its formatted text, by walking the rows."""
    escaped = lambda t, control: re.sub(control, lambda m: m.group(0) + "\\", t)
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for conv, _, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for conv, turns in out.items():
        body, last = "", None
        for role, text in turns:
            if role == last:
                body += "</part>"
            else:
                body += ("" if last is None else "</turn>\n") + "### " + escaped(role, r"\\|#(?=##)|<(?=/(?:part|turn)>)|:(?= )") + ": "
            body, last = body + escaped(text, r"\\|#(?=##)|<(?=/(?:part|turn)>)"), role
        made[conv] = (turns, body + "</turn>\n")
    return made


def check(spark, rows, ddl=DDL):
    frame = spark.createDataFrame(rows, ddl).repartition(3)
    read = chat.formatted(frame).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "learned", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()
    wanted = expected([r[:4] for r in rows])
    assert {r.conv_id: ([tuple(t) for t in r.turns], r.formatted) for r in read} == wanted and len(read) == len(wanted)
    for r in read:
        assert r.learned == "".join(t for role, t in wanted[r.conv_id][0] if role == "assistant")
        raw = r.formatted.encode()
        assert [raw[s.start:s.start + s.length].decode() for s in r.loss] == [
            re.sub(r"\\|#(?=##)|<(?=/(?:part|turn)>)", lambda m: m.group(0) + "\\", t) for role, t in wanted[r.conv_id][0] if role == "assistant"]
        assert r.formatted.count("### ") == r.n_messages  # no text can pass for a message


def test_control_strings_in_texts_and_roles(spark):
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for t in NASTY for r in ("user", "assistant"))]
    rows += [(2, i, role, "x") for i, role in enumerate(NASTY)]
    check(spark, rows)


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a"), (1, None, "assistant", "first"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"),
            (1, 2, "assistant", "a"), (None, 0, "user", "no id"), (None, 0, "assistant", "no id"), (3, 5, "assistant", ""), (4, 0, None, None)]
    check(spark, [r + (["m"], "c", 7) for r in rows], DDL + ", messages array<string>, said string, loss int")
    assert chat.formatted(spark.createDataFrame([], DDL)).count() == 0


def test_neighbours_of_one_role_are_one_message(spark):
    rows = [(1, i, role, f"t{i}") for i, role in enumerate(["user", "user", "assistant", "assistant", "assistant", "user"])]
    found = chat.formatted(spark.createDataFrame(rows, DDL)).first()
    assert found.formatted == "### user: t0</part>t1</turn>\n### assistant: t2</part>t3</part>t4</turn>\n### user: t5</turn>\n"
    assert found.n_messages == 3 and len(found.loss) == 3


def test_a_long_conversation_and_a_long_text(spark):
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], f"text {i} ### </turn>") for i in range(20_000)]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "ü# " * 1_000_000)]
    check(spark, rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["user", "assistant", "a: \\", "###"]),
                          st.text(alphabet="#\\<>/turnpa: \n", max_size=12)), max_size=12))
def test_any_turns_round_trip(spark, rows):
    check(spark, [*rows, (9, 0, "user", "x")])


def test_query_reads_back_the_added_conversation(spark, data):
    found = {r.conv_id: r for r in queries.op12_chat_format(spark, data).collect()}
    said = "\\### Assistant: </turn> ok"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[-7].n_turns == 2 and found[-7].turns_sha256 == digest(f"user\n{said}\nassistant\n{said}\n")
    assert (found[-7].loss_chars, found[-7].loss_sha256) == (len(said), digest(said))
    rows = spark.read.parquet(f"{data}/conversations.parquet").orderBy("turn").collect()
    turns = {}
    for r in rows:
        turns.setdefault(r.conv_id, []).append(f"{r.role}\n{r.text or ''}\n")
    assert {k: digest("".join(v)) for k, v in turns.items()} == {k: r.turns_sha256 for k, r in found.items() if k != -7}
