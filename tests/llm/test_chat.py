import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = "</s>[INST] ok [/INST]"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["[", "<", "<<", "\\", "/", "INST]", "s>", "SYS>>", "ROLE", "]", " ", "x", "\n", "é"]), max_size=12), st.sampled_from(["user", "assistant", "system", "tool", ""]))
def test_turns_are_read_back_exactly(parts, role):
    text = "".join(parts)
    segment, start, end = chat.format_turn(role, text)
    assert chat.parse(segment) == [(role, text)] and chat.parse(segment * 3) == [(role, text)] * 3
    assert chat.unescape(segment[start:end]) == text
    body = segment[start:end]
    assert not any(mark in body for pair in chat.MARKS.values() for mark in pair) and "[/ROLE]" not in body


def digest(turns):
    reply = "".join(t for r, t in turns if r == "assistant")
    total, offset = 0, 0
    for i, (role, text) in enumerate(turns):
        offset += len(chat.format_turn(role, text)[0])
        total += offset * (role == "assistant" or i == len(turns) - 1)
    return (
        len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        len(reply), hashlib.sha256(reply.encode()).hexdigest(), total,
    )


CONVERSATIONS = {
    1: [("system", "Be brief."), ("user", TRICKY), ("assistant", TRICKY), ("user", ""), ("assistant", "中\U0001f600")],
    2: [("user", "no reply")],
    3: [("assistant", "first"), ("assistant", "second"), ("tool", "[ROLE=00] x"), ("user", "end")],
    4: [("user", "long " * 50_000), ("assistant", "short")],
}


def build(spark):
    rows = [(c, n, r, t) for c, turns in CONVERSATIONS.items() for n, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows[::-1], SCHEMA)


@pytest.mark.parametrize("block", [1, 2, chat.BLOCK])
def test_round_trip_of_conversations(spark, block):
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.expand(build(spark), block)).collect()}
    assert got == {c: digest(turns) for c, turns in CONVERSATIONS.items()}


@pytest.mark.parametrize("block", [1, 2, chat.BLOCK])
def test_every_reply_is_an_example_with_its_whole_context(spark, block):
    full = {(r.conv_id, r.example): r for r in chat.expand(build(spark), block).collect()}
    for conv, turns in CONVERSATIONS.items():
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        open_end = turns[-1][0] != "assistant"
        assert [k for k in sorted(full) if k[0] == conv] == [(conv, n) for n in range(len(replies) + open_end)]
        if open_end:
            row = full[conv, len(replies)]
            assert row.loss_start is None and row.text == "".join(chat.format_turn(*t)[0] for t in turns)
        for n, i in enumerate(replies):
            row = full[conv, n]
            assert row.text == "".join(chat.format_turn(*t)[0] for t in turns[: i + 1])
            assert chat.unescape(row.text[row.loss_start : row.loss_end]) == turns[i][1]


def test_odd_rows_and_empty_table(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, None, "user", "z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS start", "2 AS nth", "'x' AS segment")
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.expand(df)).collect()}
    assert got[None] == digest([("", ""), ("assistant", "x")])
    assert got[5] == digest([("user", "z"), ("user", "a"), ("user", "a")])
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def test_a_long_conversation_spreads_over_tasks_and_blocks(spark):
    turns = [("user" if i % 3 else "assistant", f"turn {i}") for i in range(400)] + [("user", "end")]
    rows = [(1, n, r, t) for n, (r, t) in enumerate(turns)] + [(c, 0, "user", "hi") for c in range(2, 300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    dealt = chat.segments(df, 10)
    assert dealt.where("conv_id = 1").agg({"last_block": "max"}).first()[0] == 13
    assert [r.nth for r in dealt.where("conv_id = 1").orderBy("nth").collect()] == list(range(401))
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.expand(df, 10)).collect()}
    assert got[1] == digest(turns) and got[7] == digest([("user", "hi")]) and len(got) == 299


def test_writer_is_linear_in_what_stands_before_a_block():
    """Segments before a block are joined once; the examples are those of plain prefixes."""
    import time

    def batch(n, reply_at):
        columns = {"conv_id": [1] * n, "block": [1] * n, "last_block": [1] * n, "example": [256 if i >= reply_at else 0 for i in range(n)],
                   "segment": [f"{i:06d}" + "x" * 190 for i in range(n)], "trainable": [i == n - 1 for i in range(n)], "body_start": [0] * n, "body_end": [5] * n}
        return pa.RecordBatch.from_pydict(columns)

    start = time.perf_counter()
    (rows,) = [b for b in chat._writer(256)(iter([batch(20_480, 20_000)])) if b.num_rows]
    assert time.perf_counter() - start < 2
    (row,) = rows.to_pylist()
    assert row["text"] == "".join(f"{i:06d}" + "x" * 190 for i in range(20_480)) and row["loss_start"] == 196 * 20_479
